"""The queries of this package, one for each operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.llm import bpe, chat, exact_dedup, hilbert, language, licenses, line_rules, merkle, near_dedup, ngram_join, packing, prefix_trie, records
from cordwood.llm.shared import Scratch, table, with_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(function: Query) -> Query:
    """Register a query under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(with_package(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op1_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates over all documents, by runs of four words."""
    settings = near_dedup.Settings(width=4, percent=80)
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"], settings)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards along a curve through language, source and size."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    sized = docs.select(
        "doc_id", "lang", "source", "text", size.alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32")
    )
    dimensions = [
        hilbert.Dimension("lang", F.col("lang")),
        hilbert.Dimension("source", F.col("source")),
        hilbert.NumberDimension("size", F.col("size")),
    ]
    found = hilbert.shard(sized, ["doc_id", "size", "text_crc32"], dimensions, shards=16)
    return found.select(
        "row.doc_id",
        "row.size",
        "row.text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


@query
def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdicts of all documents."""
    judged = line_rules.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_common_lines",
        "n_removed_words",
    )


@query
def op4_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level BPE ids, and back."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), ["doc_id"], ranks, pattern)
    decoded = bpe.decode_documents(encoded, ranks)
    return decoded.select(
        "row.doc_id",
        "n_tokens",
        F.sha2("ids_text", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return groups.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, WORD_TOKENIZER, capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def is_held_out() -> Column:
    """Documents that no language model learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@query
def op7_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~is_held_out()))
    found = language.identify(docs, ["doc_id"], model).select("row.doc_id", "lang_pred", "score", "accepted")
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "accepted")


@query
def op8_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as records in ``doc_id`` order and read back from the files."""
    folder = Scratch(spark, "records").folder("shards")
    records.write_records(table(spark, sf_dir, "documents"), WORD_TOKENIZER, folder, end_id=1)
    read = records.read_records(spark, folder, keep_ids=False)
    return read.select("doc_id", F.col("before").alias("start"), "n_tokens", "ids_crc32")


@query
def op9_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license detections of all documents."""
    found = licenses.scan_documents(table(spark, sf_dir, "documents"), ["doc_id"])
    base, own = F.col("base.label"), F.col("detections.label")

    def joined(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    return found.select(
        "row.doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.coalesce(F.array_max("detections.score"), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )


CONTROL_STRINGS = "<|im_end|><|im_start|>assistant ok"


@query
def op10_offset_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back, with one made of control strings."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = [(-1, 0, "user", CONTROL_STRINGS), (-1, 1, "assistant", CONTROL_STRINGS)]
    told = told.unionByName(spark.createDataFrame(more, "conv_id long, turn long, role string, text string"))
    formatted = chat.format_conversations(told, public_tokenizers.path("byte_bpe_50k.json"))
    return chat.read_back(formatted)


@query
def op11_vertical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their runs of five words."""
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op12_hashed_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that take their first turns from one of their family."""
    scratch = Scratch(spark, "trie")
    conv = F.col("conv_id")
    base, borrowed = conv - conv % 5, F.crc32(conv.cast("string")) % 9
    is_base = conv % 5 == 0
    convs: list[DataFrame] = []

    def with_base(runs: DataFrame) -> DataFrame:
        sizes = runs.groupBy("conv_id").agg(F.max("n").alias("n"))
        bases = sizes.select(conv.alias("base"), F.col("n").alias("n_base"))
        known = sizes.withColumn("base", base).join(bases, "base", "left").fillna(0, ["n_base"])
        taken = F.least(borrowed, F.col("n_base"))
        n_turns = F.when(is_base, F.col("n")).otherwise(taken + F.greatest(F.col("n") - borrowed, F.lit(0)))
        known = known.select("conv_id", taken.alias("taken"), n_turns.alias("n_turns"))
        convs.append(scratch.write(known, "conversations"))
        return runs.join(convs[0], "conv_id")

    turns = prefix_trie.in_order(scratch, table(spark, sf_dir, "conversations"), with_base)
    held = ["n_turns", "n_bytes", "t1", "t2"]
    place = F.when(is_base, F.col("idx")).otherwise(F.col("taken") + F.col("idx") - borrowed)
    own = turns.where(is_base | (F.col("idx") >= borrowed)).select("conv_id", (place + 1).alias("depth"), *held)
    family = F.explode(F.filter(F.sequence(conv - 4, conv + 4), lambda c: (c != conv) & (c - c % 5 == conv)))
    heads = turns.where(is_base & (F.col("idx") < 8)).drop("n_turns").withColumn("conv_id", family)
    heads = heads.where(F.col("idx") < borrowed).join(convs[0].select("conv_id", "n_turns"), "conv_id")
    heads = heads.select("conv_id", (F.col("idx") + 1).alias("depth"), *held)
    rebuilt = scratch.write(own.unionByName(heads), "rebuilt")
    found = prefix_trie.prefix_trie(scratch, rebuilt, convs[0].where("n_turns = 0"))
    return found.withColumnRenamed("saved_bytes", "saved_tokens")


@query
def op13_sibling_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, some of them checked with a text that was changed."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_digest(*fields, F.col("text"))
    shorter = merkle.leaf_digest(*fields, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    is_even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    shown = docs.withColumn("shown", F.when(is_even, shorter).otherwise(leaf))
    found = merkle.manifest(shown, ["doc_id", "shown"], leaf, group="source", order=["doc_id"], arity=3)
    folded = merkle.fold(F.col("row.shown"), F.col("path"))
    return found.withColumn("folded", folded).select(
        "row.doc_id",
        *(merkle.hex_text(F.col(name)).alias(name) for name in ("leaf", "subroot", "root")),
        F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"),
        merkle.hex_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


# The same results in SQL, where it can express them.

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL["op5_block_naming"] = f"""WITH lowered AS (
 SELECT doc_id, translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
 doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM lowered WINDOW same AS (PARTITION BY text)"""

SQL["op3_line_frequency"] = rf"""WITH texts AS (
 SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
worded AS (
 SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM texts),
runs AS (
 SELECT doc_id, i, words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2] AS run
 FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM worded)),
repeated AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
covered AS (
 SELECT doc_id, count(DISTINCT place) AS n_repeat_words
 FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM repeated) GROUP BY doc_id),
lines AS (
 SELECT *, regexp_replace(regexp_replace(lower(trim(line, {_BLANKS})), '[\x20\x09-\x0D]{{2,}}', ' ', 'g'), '[0-9]+', '0', 'g') AS normal
 FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM texts)
 WHERE trim(line, {_BLANKS}) <> ''),
hosts AS (SELECT host, count(DISTINCT text) AS documents FROM texts GROUP BY host),
counted AS (SELECT host, normal, count(DISTINCT text) AS n FROM lines GROUP BY host, normal),
common AS (SELECT host, normal FROM counted JOIN hosts USING (host) WHERE n > 20 OR n > 5 AND n > documents * 0.1),
removed AS (
 SELECT doc_id, count(*) AS n_common_lines,
  sum(len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS n_removed_words
 FROM lines JOIN common USING (host, normal) GROUP BY doc_id),
doubled AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
figures AS (
 SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_common_lines, 0) AS n_common_lines, CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
 FROM worded LEFT JOIN covered USING (doc_id) LEFT JOIN doubled USING (doc_id) LEFT JOIN removed USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT *, NOT base_failed AND n_removed_words <= n_words * 0.5 AS kept FROM judged"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: a byte comes in as its number, eight bits go out as -1."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    turn = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    last = f"list_reduce(list_prepend(4294967295::BIGINT, {steps}::BIGINT[]), lambda c, s: CASE WHEN s < 0 THEN {turn} ELSE xor(c, s) END)"
    return f"xor({last}, 4294967295)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


SQL["op11_vertical_join"] = rf"""WITH RECURSIVE worded AS (
 SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}'),
  '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
runs AS (
 SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS run
 FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM worded WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
links AS (
 SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM runs x JOIN runs y USING (run) GROUP BY ALL)
 JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reached GROUP BY a) USING (doc_id)"""

SQL["op12_hashed_trie"] = f"""WITH turns AS (
 SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
told AS (
 SELECT conv_id AS c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS turns
 FROM turns GROUP BY conv_id),
rebuilt AS (
 SELECT c, list_concat(coalesce(base.turns, [])[1:h], own.turns[h + 1:]) AS turns
 FROM (SELECT *, CAST({_crc32_sql("c::VARCHAR")} % 9 AS BIGINT) AS h FROM told) own
 LEFT JOIN (SELECT c AS b, turns FROM told) base ON base.b = c - c % 5),
prefixes AS (
 SELECT c, d, len(turns) AS n, turns[1:d] AS prefix FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
 SELECT min(c) AS conv_id, d AS depth, prefix, count(*) AS n_convs,
  (count(*) - 1) * coalesce(strlen(prefix[d].text), 0) AS saved,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
 FROM prefixes GROUP BY d, prefix),
parents AS (
 SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN children USING (conv_id, depth)),
below AS (
 SELECT a.conv_id, a.depth, count(*) FILTER (n.n_children = 0) AS n_leaves, CAST(sum(n.saved) AS BIGINT) AS saved_tokens
 FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted) n
 JOIN nodes a ON a.depth = n.up AND a.prefix = n.prefix[1:n.up] GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counted JOIN below USING (conv_id, depth)"""

SQL["op13_sibling_merkle"] = f"""WITH RECURSIVE rows AS (
 SELECT doc_id, source, concat({", ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars")))}) AS head, text,
  {_crc32_sql("doc_id::VARCHAR")} AS crc FROM documents),
leaves AS (
 SELECT doc_id, source, sha256(head || {_field_sql("text")}) AS leaf,
  sha256(head || {_field_sql("CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS shown FROM rows),
placed AS (
 SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
  count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS gid FROM leaves),
nodes AS (
 SELECT gid, 0 AS level, idx, n, leaf AS digest FROM placed
 UNION ALL
 SELECT gid, min(level) + 1, idx // 3, (min(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
 FROM nodes WHERE n > 1 GROUP BY gid, idx // 3),
upper AS (
 SELECT 0 AS level, gid AS idx, count(*) OVER () AS n, digest FROM nodes WHERE n = 1
 UNION ALL
 SELECT min(level) + 1, idx // 3, (min(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
 FROM upper WHERE n > 1 GROUP BY idx // 3),
sides AS (
 SELECT above, level, g, i,
  coalesce(string_agg(digest, '' ORDER BY i) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(digest, '' ORDER BY i) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
 FROM (SELECT FALSE AS above, level, gid AS g, idx AS i, digest FROM nodes WHERE n > 1
  UNION ALL SELECT TRUE, level, 0, idx, digest FROM upper WHERE n > 1)
 WINDOW run AS (PARTITION BY above, level, g, i // 3 ORDER BY i)),
-- Upper levels go on where the lower ones of a group end.
folds AS (
 SELECT gid, idx, 0 AS level, FALSE AS above, n, shown AS folded, '' AS proof, gid AS g, idx AS i FROM placed
 UNION ALL
 SELECT f.gid, f.idx, CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END, f.above OR f.n = 1,
  CASE WHEN f.n = 1 THEN u.n ELSE (f.n + 2) // 3 END,
  CASE WHEN f.n = 1 THEN f.folded ELSE sha256(s.before || f.folded || s.behind) END,
  CASE WHEN f.n = 1 THEN f.proof ELSE f.proof || s.before || s.behind END,
  f.g, CASE WHEN f.n = 1 THEN f.g ELSE f.i // 3 END
 FROM folds f CROSS JOIN (SELECT max(n) AS n FROM upper) u
 LEFT JOIN sides s ON s.above = f.above AND s.level = f.level AND s.i = f.i AND (f.above OR s.g = f.g)
 WHERE NOT (f.above AND f.n = 1))
SELECT p.doc_id, p.leaf, subroots.digest AS subroot, root.digest AS root, sha256(f.proof) AS proof_sha256,
 f.folded AS folded_root, f.folded = root.digest AS verified
FROM placed p JOIN folds f ON f.gid = p.gid AND f.idx = p.idx AND f.above AND f.n = 1
JOIN nodes subroots ON subroots.gid = p.gid AND subroots.n = 1
JOIN upper root ON root.n = 1"""
