"""The library's registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""
