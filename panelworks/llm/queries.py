"""The queries of this subpackage for ``__spark_entry__``: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import chat, ctw, decontam, jaccard, langid, linededup, media, merkle, mixing, packing, phrases, toxicity, urlrules
from panelworks.llm.common import held_out, remainder, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 5, 0))
    labels = _table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.fit_on(docs.select("doc_id", "text"), labels)
    out = docs.withColumn("t", toxicity.score(model, spark, F.col("text")))
    return out.select("doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.col("t.n_hits").alias("n_hits"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 4, 2))
    model = langid.fit(docs.filter("not held_out"))
    out = docs.select("doc_id", "held_out", langid.predict(model, spark, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


#: Shares of tokens that the mix is to have of each domain, and its size for that of the corpus.
SHARES = {"high": 0.80, "low": 0.15, "toxic": 0.05}
TOTAL = 1.15


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = mixing.mix(_table(spark, sf_dir, "documents"), mixing.label_domains(_table(spark, sf_dir, "labels")), SHARES, TOTAL)
    return rows.select("doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{x}") for i, x in enumerate(SHARES)], "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.summary(decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = media.media_folder(spark)
    refs = stored(media.write_media(_table(spark, sf_dir, "documents"), folder))
    info = stored(media.features(refs, folder).join(media.metadata(refs, folder), "digest"))
    out = media.attached(refs, info)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "bits")


#: Fixed url rules of the query: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return urlrules.judge(_table(spark, sf_dir, "pages"), labels, URL_RULES)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    maps = linededup.bitmaps(docs, min_docs=10, min_chars=1, keep="none")
    out = linededup.with_bitmaps(docs, maps)
    kept = linededup.kept_lines(F.col("text"), F.col("dropped"))
    n_dropped = F.coalesce(F.aggregate(F.map_values("dropped"), F.lit(0).cast("long"), lambda a, b: a + F.bit_count(b)), F.lit(0).cast("long"))
    return out.select("doc_id", F.size(linededup.lines_of(F.col("text"))).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), F.sha2(F.array_join(kept, "\n").cast("binary"), 256).alias("kept_sha256"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.pieces(turns))


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ctw.scores(_table(spark, sf_dir, "documents"), ~held_out("doc_id", 10, 0), depth=5)
    bits = -F.col("score") / F.lit(0.30102999566398120) / F.greatest(F.lit(1), F.col("n_bytes"))
    return out.select("doc_id", held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))


#: Fields of a row's digest.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tampered(docs: DataFrame):
        altered = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
        return F.when((remainder("doc_id", 7) == 0) & F.col("n_chars").isNotNull(), merkle.digest(altered))

    return merkle.manifest(_table(spark, sf_dir, "documents"), FIELDS, "lang", "doc_id", tampered)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), size=3, least=10, inside=50, top=2000).withColumnRenamed("grp", "lang")


#: Tokenizer of the packing query, and a sequence's tokens.
VOCABULARY, SEQUENCE = "word_bpe_49k.json", 4096


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    placed = packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), size=SEQUENCE), SEQUENCE)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_langid, op3_mixing, op4_jaccard, op5_decontamination, op6_media, op7_url_filter, op8_line_dedup, op9_chat, op10_ctw, op11_manifest, op12_collocations, op13_packing)
}

SQL: dict[str, str] = {
    "op9_chat": r"""
with t as (
  select conv_id, turn, role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(text) + (length(text) - length(translate(text, '\<[|', ''))) + length(role) + (length(role) - length(translate(role, '\<[|', ''))) + 11 as chars from t),
f as (select *, coalesce(sum(chars) over (partition by conv_id order by turn, role, text rows between unbounded preceding and 1 preceding), 0) before from e)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256, sum(chars)::bigint formatted_chars,
  count(*) filter (role = 'assistant')::bigint n_examples, coalesce(sum(before) filter (role = 'assistant'), 0)::bigint context_chars
from f group by conv_id""",
    "op5_decontamination": r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws from documents),
b as (
  select item_id::varchar item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws from benchmark),
win as (
  select distinct item_id, list_slice(ws, i, i + 9) g from b, unnest(range(1, greatest(1, len(ws) - 9)::bigint + 1)) u(i) where len(ws) > 0),
sizes as (select distinct len(g) n from win),
grams as (
  select doc_id, i, n, list_slice(ws, i, i + n - 1) g from w, sizes, unnest(range(1, len(ws) - n + 2)) u(i)),
hits as (select doc_id, i, n, item_id from grams join win using (g)),
pos as (select doc_id, count(distinct p) n_hit from hits, unnest(range(i, i + n)) u(p) group by doc_id),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) s from hits group by doc_id)
select w.doc_id, coalesce(len(ws), 0)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join pos using (doc_id) left join its using (doc_id)""",
    "op8_line_dedup": r"""
with l as (
  select doc_id, i, ln, translate(trim(ln, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) ln, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents)),
f as (select k from l where k <> '' group by k having count(distinct doc_id) >= 10),
m as (select l.*, f.k is not null gone from l left join f using (k))
select doc_id, count(*)::bigint n_lines, sum(gone::int)::bigint n_dropped,
  sha256(coalesce(string_agg(ln, chr(10) order by i) filter (not gone), '')) kept_sha256
from m group by doc_id""",
    "op11_manifest": r"""
with recursive base as (
  select doc_id, lang, n_chars, sha256(h || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || t) leaf, sha256(h || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || t) altered
  from (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') h, coalesce(strlen(text) || ':' || text, '-') t from documents)),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 i from base),
lv as (
  select lang, 0 h, i, leaf x from leaves
  union all select lang, h + 1, i // 2, sha256(string_agg(x, '' order by i)) from (select *, count(*) over (partition by lang) c from lv) where c > 1 group by lang, h, i // 2),
subs as (select lang, row_number() over (order by lang nulls first) - 1 i, x from (select lang, arg_max(x, h) x from lv group by lang)),
tv as (
  select 0 h, i, x from subs
  union all select h + 1, i // 2, sha256(string_agg(x, '' order by i)) from (select *, count(*) over () c from tv) where c > 1 group by h, i // 2),
root as (select arg_max(x, h) x, max(h) top from tv),
tops as (select lang, max(h) top from lv group by lang),
crcs as (
  select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::bigint) crc
  from (select distinct doc_id from documents where doc_id is not null)),
low as (
  select doc_id, l.lang, l.leaf, 0 h, l.i, case when tamper and n_chars is not null then altered else leaf end x, '' p, tops.top
  from (select *, coalesce(crc % 7 = 0, false) tamper from leaves left join crcs using (doc_id)) l join tops on l.lang is not distinct from tops.lang
  union all select doc_id, lang, leaf, h + 1, i // 2, sha256(case when s is null then x when i % 2 = 1 then s || x else x || s end), p || coalesce(s, ''), top
  from (select low.*, lv.x s from low left join lv on lv.lang is not distinct from low.lang and lv.h = low.h and lv.i = case when low.i % 2 = 0 then low.i + 1 else low.i - 1 end where low.h < low.top)),
high as (
  select doc_id, leaf, subs.x subroot, 0 h, subs.i, low.x, p from low join subs on low.lang is not distinct from subs.lang where low.h = low.top
  union all select doc_id, leaf, subroot, h + 1, i // 2, sha256(case when s is null then x when i % 2 = 1 then s || x else x || s end), p || coalesce(s, '')
  from (select high.*, tv.x s from high join root on high.h < root.top left join tv on tv.h = high.h and tv.i = case when high.i % 2 = 0 then high.i + 1 else high.i - 1 end))
select doc_id, leaf, subroot, root.x root, sha256(p) proof_sha256, high.x folded_root, high.x = root.x verified from high join root on high.h = root.top""",
    "op12_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') lang, doc_id, generate_subscripts(s, 1) pc, unnest(s) t
  from (select lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') s from documents)),
ws as (select lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') w from pieces),
w as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) phrase from ws, (values (1), (2), (3)) ks(k)),
f as (select lang, k, phrase, count(*)::bigint f from w group by 1, 2, 3),
nn as (select lang, sum(f)::bigint n from f where k = 1 group by 1),
c as (select lang, k, phrase, string_split(phrase, ' ') s, f a from f where k > 1 and f >= 10),
cuts as (
  select c.lang, c.k, c.phrase, c.s, c.a, cut, l.f l, r.f r, ((1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f))::bigint score
  from (select c.*, unnest(range(1, k)) cut from c) c join f l on l.lang = c.lang and l.phrase = array_to_string(s[1:cut], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(s[cut + 1:], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (select lang, phrase, max(a) longest from (select lang, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) phrase, a from c where k = 3) group by 1, 2),
kept as (select b.*, n from best b join nn using (lang) left join longer using (lang, phrase) where longest is null or 100 * longest < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a, l, r, n, score from ranked where rank <= 2000""",
}
