"""Return-panel analytics and statistical learning as Spark jobs."""
