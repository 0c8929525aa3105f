"""The queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, chat, fim, media, ngram_join, packing, phrases, pii, quality, quality_rules, sharding, token_counts, toxicity
from strandline.llm.common import held_out, table


def _vocabulary(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes they decode to, as digests; null text is empty, equal texts have equal rows."""
    path, pattern = _vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text"), path, pattern).alias("ids"))
    both = docs.select("doc_id", "ids", bpe.decode(F.col("ids"), path, pattern).alias("raw"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, repeated rows each; null text is empty, equal texts score alike."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as GIF frames and read back; null text is empty, a payload of 64 zeros. The feature is the number of frames, their time and the colour histogram."""
    docs = table(spark, sf_dir, "documents")
    raw = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), media.payload(F.col("text")).alias("payload"))
    stored = raw.select("doc_id", "n_bytes", media.to_gif(F.col("payload")).alias("media"))
    read = stored.select("doc_id", "n_bytes", "media", media.summary(F.col("media")).alias("s"))
    back = F.col("s.samples")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(back).cast("long").alias("payload_bytes"),
        F.sha2(back, 256).alias("payload_sha256"),
        F.crc32(F.substring(back, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.col("s.n_frames").cast("string"), F.col("s.duration_ms").cast("string"), F.array_join(F.col("s.histogram").cast("array<string>"), ",")).alias("feature"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of nearly equal bytes, equal texts next to each other; null text has no bytes."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document (three-word shingles, 0.9); null and blank texts are alone, rows that repeat an id are one document."""
    return ngram_join.join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place; null text is empty, repeated rows get places of their own."""
    # The rank file holds the vocabulary of byte_bpe_50k.json; tests hold the ids against the tokenizers library.
    path, pattern = _vocabulary("byte_bpe_50k.tiktoken")
    special = bpe.special_tokens(_vocabulary("byte_bpe_50k.json")[0])
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), path, pattern, special=special)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and all spans of every document; null text has none, equal texts have equal spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii.detect(docs.select("doc_id", "text"), pii.fit(docs), keep=["doc_id"])
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    many = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *many, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, repeated rows each; null text is empty, equal texts score alike."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every whole text; null and empty texts have none."""
    path, _ = _vocabulary("piece_bpe_32k.model")
    return table(spark, sf_dir, "documents").select("doc_id", token_counts.count(F.col("text"), path).alias("c")).select("doc_id", "c.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; null and empty texts have no words and fail the base test."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs.select("doc_id", "text"), rules, keep=["doc_id"])
    counts = [F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept", "rule")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language; null text is empty, a null language ``und``, repeated rows count each."""
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, as digests; null text is empty and plain, repeated rows fare alike."""
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "row.doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one string, read back; null texts are empty, rows that repeat a turn are turns each. Conversation -7
    is a record of its own, of the layout that has a prompt and a response."""
    said = "</s>[INST] ok [/INST]"
    added = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_variant_object(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    made = chat.convert(chat.by_conversation(table(spark, sf_dir, "conversations"), added), "record")
    back = chat.under_loss(made, F.col("chat.text"), F.col("chat.loss"), "loss")
    read = back.select("row.conv_id", "chat.layout", F.length("chat.text").cast("long").alias("formatted_chars"), chat.read_turns(F.col("chat.text")).alias("turns"), "loss")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        chat.digest_of(F.col("turns")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "layout",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality": op2_quality,
    "op3_gif": op3_gif,
    "op4_sharding": op4_sharding,
    "op5_ngram_join": op5_ngram_join,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "op11_phrases": op11_phrases,
    "op12_fim": op12_fim,
    "op13_chat": op13_chat,
}

#: DuckDB SQL of the queries that SQL can express; the others are held against brute force in tests.
ORACLE_SQL: dict[str, str] = {
    "op5_ngram_join": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w),
u as (select doc_id, len(s) as n, unnest(s) as g from s),
links as (
  select a.doc_id as a, b.doc_id as b from u a join u b using (g) group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a)
select doc_id, len(s)::bigint as n_shingles, coalesce((select min(b) from reach where a = doc_id), doc_id) as component_id from s""",
    "op11_phrases": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from words, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k),
f as (select lang, phrase, any_value(k) as k, count(*) as a from grams group by lang, phrase having count(*) >= 100),
n as (select lang, sum(len(w)) as n from words group by lang),
cuts as (
  select lang, phrase, k, a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') as p, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') as q
  from f, (select unnest([1, 2, 3, 4]) as cut) where k > 1 and cut < k),
scored as (
  select c.lang, c.phrase, c.a, l.a as l, r.a as r, n.n, c.cut, (1000::hugeint * c.a * n.n) // (l.a::hugeint * r.a) as score
  from cuts c join f l on l.lang = c.lang and l.phrase = c.p join f r on r.lang = c.lang and r.phrase = c.q join n on n.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (select a.lang, a.phrase from f a join f b on a.lang = b.lang and b.k > a.k and b.a >= a.a and contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ') where a.k > 1 group by all),
kept as (select * from best anti join longer using (lang, phrase))
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= 2000""",
}
