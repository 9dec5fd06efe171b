"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embed_dedup, fingerprint, html_text, jaccard_join, license, line_dedup, mixing, periodic, quality, repair, token_store
from .common import SPACE, let, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share. A null text is one empty line; rows that repeat or share an id count and stay each for itself."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back. Turns that share a number stand by role, then text; null roles and texts are empty, a null conv_id is a conversation."""
    own = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat.read_back(chat.format_chat(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's. A null text is empty; null ids come last, rows of one id follow each other by text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = fingerprint.with_next(fingerprint.fingerprints(docs), "doc_id", ["text", "packed"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", "text"), F.lit(1), half)))
    rows = rows.withColumn("edited_packed", fingerprint.packed_fingerprint(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint.as_hex(F.col("edited_packed")).alias("edited_fingerprint"), fingerprint.likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"), fingerprint.likeness(F.col("packed"), F.col("next_packed")).alias("near_next"))


def op4_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The token store of all documents, written and read back. A null text is the end id alone; rows that share an id follow each other by their Merkle roots, null ids first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = token_store.write_store(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return store.documents().withColumnRenamed("id", "doc_id")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.85 on four-word shingles. Texts without words link with nothing; rows without an id or with a shared one stay."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, p=17, q=20).select("doc_id", "n_shingles", "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from labels of two thirds of the ids. A null or empty text is scored as one without words; a null id is not held out."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learned(docs, table(spark, sf_dir, "labels").where(~held))
    return quality.classify(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and passages in every text. A null text has no words."""
    return license.scan(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors at a cosine of 0.9. Null, zero and non-finite vectors link with nothing; rows that share an id are vectors each."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Token ids of every text and what they decode to. A null text has none; rows that repeat or share an id are coded each for itself."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. A null text has size 0 and is not taken; a null source is the last source; rows that repeat are taken alike."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def _with_repeats(doc_id: Column, text: Column) -> Column:
    """Texts of one id in ten with their words from a certain one on replaced by a repeated stretch of them; other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1).cast("long") + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        at = lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), at), " ")).otherwise("")

    words = F.filter(F.split(text, f"[{SPACE}]+", -1), lambda x: x != "")
    return F.when(F.pmod(h, F.lit(10)) == 0, let(words, repeated)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of at least 12 words, and texts without their repeats; a null text has no words, a null doc_id no planted repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.collapse_runs(docs, least=12)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a null page gives an empty one."""
    found = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _damaged(turns: DataFrame) -> DataFrame:
    """Turns damaged by a hash of their conversation and number: one in twenty each dropped, emptied, without ends of sentences, repeated, and said by the user; nulls are one space."""
    blank = F.lit(" ")
    h = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")), F.lit(20))
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    times = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"), F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.explode(F.array_repeat(F.lit(True), times)))
    return rows.drop("col")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair. Turns that share a number stand by role, then text; a null conv_id is a conversation of its own."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    done = repair.repair(_damaged(turns)).select(F.col("conv_id").alias("id"), *counts, "audit", F.sha2(repair.text_of(F.col("turns")).cast("binary"), 256).alias("repaired_sha256"))
    ids = turns.select("conv_id").distinct()
    rows = ids.join(done, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    return rows.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_chat_format, op3_fingerprint, op4_token_store, op5_jaccard_join, op6_quality, op7_license_scan, op8_embedding_dedup, op9_byte_bpe, op10_mixing, op11_periodic_runs, op12_html_text, op13_conversation_repair)}

_BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ESCAPE = r"regexp_replace({}, '([<\[])(~*)(\|[a-z_]+\|>|/?s>|/?INST\])', '\1~\2\3', 'g')"


def _repair_sql() -> str:
    """The repair by whole layers: for every turn the best cost and audit of each grammar state (1 nothing yet, 2 system, 3 user, 4 assistant), folded over the turns."""
    best = lambda *ways: f"list_min([{', '.join(ways)}])"
    way = lambda state, cost, edit, only="true": f"CASE WHEN {only} THEN {{'c': acc[{state}].c + {cost}, 'a': acc[{state}].a || '{edit}'}} ELSE {{'c': 1000000000000::BIGINT, 'a': ''}} END"
    add = lambda x, only: f"{{'c': {x}.c + CASE WHEN {only} THEN 3 ELSE 1000000000000 END, 'a': {x}.a || 'I'}}"
    stays, late = "x.fault NOT IN ('b', 'd')", "CASE x.fault WHEN 't' THEN 3 ELSE 0 END"
    kept = lambda state, initial: way(state, late, "K", f"{stays} AND x.ini = '{initial}'")
    rerole = lambda state: way(state, f"3 + {late}", "R", stays)
    e, s = way(1, 4, "D"), best(way(2, 4, "D"), kept(1, "s"))
    u = best(way(3, 4, "D"), *[f(k) for k in (1, 2, 4) for f in (lambda k: kept(k, "u"), rerole)])
    a = best(way(4, 4, "D"), kept(3, "a"), rerole(3))
    moved = f"[{e}, {s}, {u}, {a}]"
    user = f"list_min([y[3], {add('y[1]', 'true')}, {add('y[2]', 'true')}, {add('y[4]', 'true')}])"
    closed = f"list_transform([{moved}], lambda y: [y[1], y[2], {user}, list_min([y[4], {add(user, 'true')}])])[1]"
    start = "[{'c': 0::BIGINT, 'a': ''}, {'c': 1000000000000::BIGINT, 'a': ''}, {'c': 3::BIGINT, 'a': 'I'}, {'c': 6::BIGINT, 'a': 'II'}]"
    role = "CASE s WHEN 3 THEN 'assistant' ELSE 'user' END"
    after = "CASE s WHEN 3 THEN 4 ELSE 3 END"
    at = lambda x: x.replace("CASE s ", "CASE o.s ")
    said = f"CASE ed WHEN 'D' THEN [] WHEN 'I' THEN [{at(role)} || ':'] WHEN 'R' THEN [{at(role)} || ':' || rows_[o.i + 1].text] ELSE [rows_[o.i + 1].role || ':' || rows_[o.i + 1].text] END"
    state = f"CASE WHEN ed = 'D' THEN o.s WHEN ed = 'K' AND o.s = 1 AND rows_[o.i + 1].ini = 's' THEN 2 ELSE {at(after)} END"
    return f"""
        WITH bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE c & 1 WHEN 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
              xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
              FROM conversations, bits),
        d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
        f AS (SELECT *, CASE WHEN left(role, 1) = '' THEN '-' ELSE left(role, 1) END AS ini, right(rtrim(text, {_BLANKS}), 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
        g AS (SELECT conv_id, turn, role, text, ini, copy, CASE WHEN last = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN last IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault,
              lag(ini) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before FROM f),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
              count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, list({{'role': role, 'text': text, 'ini': ini, 'fault': fault}} ORDER BY turn NULLS FIRST, role, text, copy) AS rows_ FROM g GROUP BY conv_id),
        w AS (SELECT *, list_reduce(rows_, lambda acc, x: {closed}, {start}) AS ends FROM c),
        b AS (SELECT *, list_min([ends[1], ends[4]]) AS way FROM w),
        r AS (SELECT *, list_reduce(string_split(way.a, ''), lambda o, ed: {{'i': o.i + CASE ed WHEN 'I' THEN 0 ELSE 1 END, 's': {state}, 'out': list_concat(o.out, {said})}}, {{'i': 0, 's': 1, 'out': []::VARCHAR[]}}) AS made FROM b)
        SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.c, 0) AS cost, coalesce(way.a, '') AS audit,
               sha256(coalesce(array_to_string(made.out, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS ids LEFT JOIN r ON ids.conv_id IS NOT DISTINCT FROM r.conv_id"""


ORACLE_SQL = {
    "op13_conversation_repair": _repair_sql(),
    "op1_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
        k AS (SELECT r, i, line, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM l),
        hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
        m AS (SELECT k.r, k.i, k.line, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
        SELECT d.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m JOIN d ON m.r = d.r GROUP BY d.r, d.doc_id""",
    "op2_chat_format": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length({_ESCAPE.format('role')}) + length({_ESCAPE.format('text')}) + 23)::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
}
