"""Periodic runs, main text of pages, conversation repair and changes of the line index, against brute force and by example."""

import hashlib
import itertools
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from surfacis.llm import chat, common, embed_dedup, html_text, line_dedup, periodic, quality, queries, repair, token_store

SPACE = " \t\n\x0b\x0c\r"


def words_of(t):
    return [w for w in re.split(f"[{SPACE}]+", t or "") if w]


def all_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def damaged_words(doc_id, t):
    w, h = words_of(t), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("transform", [0.0, 0.3, 2.0])
def test_runs_against_brute_force(transform, monkeypatch):
    monkeypatch.setattr(periodic.lag_counts, "__defaults__", (transform,))
    rng = random.Random(int(transform * 10))
    for _ in range(80):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, v = rng.choice([0, 1, 11, 12, 40, 150]), rng.choice([1, 2, 3, 12])
            w = [str(rng.randrange(v)) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        runs, texts, n_words = periodic._found(pa.array(["\t ".join(w) or None for w in docs], pa.string()), 12)
        for w, r, text, n in zip(docs, runs, texts.to_pylist(), n_words):
            assert r == all_runs(w) and n == len(w)
            gone = {i for s, length, q in r for i in range(s + q, s + length)}
            assert text == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_long_texts_have_linear_runs():
    for w in (["a"] * 300_000, [f"x{i}" for i in range(60_000)] * 3):
        assert periodic._found(pa.array([" ".join(w)]), 12)[0] == [[(0, len(w), len(dict.fromkeys(w)))]]


def test_op11(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["the", "of", "and", "cat", "é", "x"], int(n))) for n in rng.integers(0, 90, 150)] + [None, "", " \n", "a " * 30, "one  two\x0bthree four", "b c\n" * 5000]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, "again " * 14, "en", "s", 0), (None, "n " * 20, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, *_ in rows:
        w = damaged_words(i, t) if i is not None else words_of(t)
        runs = all_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        s, n, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        want.append((i, len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_runs_keep_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a " * 12, 5, 6, 7)], "id long, text string, runs int, N int, n_words int")
    row = periodic.collapse_runs(df).collect()[0]
    assert (row.id, row.text, row.N, row.n_words, [tuple(r) for r in row.runs]) == (1, "a", 6, 12, [(0, 12, 1)])
    assert periodic.collapse_runs(df.where("id > 1")).collect() == []


PROSE = "It was a day that had been good for all of us, and so we went to the sea with the dog and sat on the sand for as long as there was sun. " * 2


def test_main_text_of_marked_and_unmarked_pages():
    around = '<header><h2>Site</h2><ul><li><a href="/">Home</a></ul></header><nav><a>Menu</a></nav><div class="cookie-notice">%s</div>' % PROSE
    after = '<div id="comments"><p>%s</p></div><form><label>%s</label></form><aside>%s</aside><footer>%s</footer>' % ((PROSE,) * 4)
    body = f"<h1>Title</h1><p>{PROSE}<p>Short &lt;one&gt; &eacute;<br>\n two<p>%%% $$$ ***<p><b>{PROSE}</p>"
    want = ["Title", PROSE.strip(), "Short <one> é two", "%%% $$$ ***", PROSE.strip()]
    for page in (f"<html><body>{around}<article>{body}</article>{after}</body></html>", f"<body class='has-sidebar'>{around}<div class=wrap>{body}</div>{after}", f"<body><main><section>{body}</section></main>{around}{after}"):
        assert html_text.main_text(page).split("\n\n") == want


def test_neighbours_decide_short_blocks():
    labels, heads = [True, None, None, None, False, None], [False, False, False, False, False, True]
    assert html_text.inherit(labels, heads, True) == [True, True, True, False, False, False]
    assert html_text.inherit([True, None, False], [False, True, False], True) == [True, False, False]
    assert html_text.inherit([None, None], [False, False], True) == [True, True]
    linked = f"<p>{PROSE}<p>By me<ul><li><a>Some other page of this site</a></ul><p>Read on<div><a>One more of them</a></div>"
    assert html_text.main_text(linked).split("\n\n") == [PROSE.strip(), "By me"]


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("a < b & c", "a < b & c"), ("<p", ""), ("<!-- x", ""), ("<!-- > x", ""), ("<script>x</p>", ""), ("<script>var a='</p>';</script>x", "x"), ("<p>x</p></p></div>y", "x\n\ny"), ("<title>t</title><p title='a>b'>x", "x"), ("x&nbsp;&#x41;&#66;", "x AB")])
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


def test_pages_are_read_in_linear_time():
    for page in ("<a '" * 100_000, "<div>" * 100_000 + "</section>" * 100_000, "<script" * 50_000, "<!--" * 100_000):
        html_text.main_text(page)


def test_op12(spark, tmp_path):
    pages = [(i, f"u{i}", f"<nav>Menu {i}</nav><article><h1>H{i}</h1><p>{PROSE * (1 if i else 300)}</article>") for i in range(30)] + [(5, None, None), (None, "u", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries.op12_html_text(spark, str(tmp_path)).collect()), key=repr)
    text = lambda i, h: f"H{i}\n\n{' '.join((PROSE * (1 if i else 300)).split())}" if h else ""
    assert got == sorted(((i, u, text(i, h), len(text(i, h))) for i, u, h in pages), key=repr)
    df = spark.createDataFrame([("<p>x", "a", 1)], "html string, text string, zone int")
    assert [tuple(r) for r in html_text.extract_text(df).select("text", "zone").collect()] == [("x", 1)]
    assert html_text.extract_text(df.where("zone > 1")).collect() == []


def every_repair(initials, faults):
    best = []

    def go(i, made, cost, audit, inserted):
        if best and cost > best[0][0]:
            return
        if i == len(initials) and re.fullmatch("(s?(ua)+)?", made):
            best[:] = [min([*best, (cost, audit)])]
        if inserted < 2:
            for c in "ua":
                go(i, made + c, cost + 3, audit + "I", inserted + 1)
        if i < len(initials):
            go(i + 1, made, cost + 4, audit + "D", 0)
            if faults[i] not in "bd":
                late = 3 * (faults[i] == "t")
                go(i + 1, made + initials[i], cost + late, audit + "K", 0)
                for c in "ua":
                    go(i + 1, made + c, cost + 3 + late, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best[0]


def test_repairs_against_every_edit():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(0, 4)
        initials, faults = "".join(rng.choice("suauax") for _ in range(n)), "".join(rng.choice("---bdt") for _ in range(n))
        assert repair.cheapest_edits(initials, faults) == every_repair(initials, faults)


def test_audits_compare_as_strings():
    rng, root, made = random.Random(5), repair.Audit(), []
    for _ in range(120):
        text, a = "".join(rng.choice("KD") for _ in range(rng.randint(0, 40))), root
        for c in text:
            a = a.plus(c)
        assert str(a) == text
        made.append((text, a))
    assert all((x < y) == (s < t) for (s, x), (t, y) in itertools.product(made, made))


def test_a_very_long_conversation():
    assert repair.cheapest_edits("ua" * 20_000, "-" * 40_000) == (0, "K" * 40_000)


def test_op13(spark, tmp_path):
    rng = random.Random(6)
    said = ["Hello.", "Well?", "cut off", " \n", "Yes!", "No. ", "é…"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", None]), rng.choice(said)) for c in range(60) for t in range(rng.randint(1, 4))]
    rows += [(100, None, "user", "Hi."), (100, None, "user", "Hi."), (100, 7, "assistant", None), (101, None, None, None), (None, 1, "user", "Hi."), (102, 1, "user", "x " * 30_000 + ".")]
    rows += [r for r in rows if r[0] in (3, 4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            role, text = "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            kept += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), ""
        for _, role, text in kept:
            last = text.strip(SPACE)[-1:]
            faults += "b" if not last else "d" if (role, text) in seen else "-" if last in ".!?" else "t"
            seen.add((role, text))
        initials, numbers = "".join(r[1][:1] or "-" for r in kept), {r[0] for r in kept} - {None}
        cost, audit = repair.cheapest_edits(initials, faults)
        left = "\n".join(f"{r}:{t}" for r, t in repair.repaired([r[1] for r in kept], [r[2] for r in kept], audit))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        want[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha(left))
    got = queries.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_repair_drops_columns_and_keeps_empty_tables(spark):
    df = spark.createDataFrame([(1, 2, "user", "Hi.", 9), (1, 5, "assistant", "Yes.", 9)], "conv_id long, turn long, role string, text string, gaps int")
    row = repair.repair(df).collect()[0]
    assert (row.n_turns, row.gaps, row.cost, row.audit, [tuple(t) for t in row.turns]) == (2, 2, 0, "KK", [("user", "Hi."), ("assistant", "Yes.")])
    assert repair.repair(df.where("turn > 9")).collect() == []


def test_line_index_takes_documents_out_once(spark):
    keys = lambda rows: line_dedup.line_keys(spark.createDataFrame(rows, "doc_id long, text string"))
    three = [(i, f"shared\nown {i}") for i in (1, 2, 3)]
    index = line_dedup.LineIndex.build(keys([*three, three[0]]), 2)
    counts = lambda x: sorted(r.n_docs for r in x.refs.collect())
    assert counts(index) == [1, 1, 2, 4]
    once = index.delete(keys([three[0], (9, "shared"), (1, "shared")]))
    assert counts(once) == [1, 1, 1, 3]
    gone = once.delete(keys([three[0]])).delete(keys([three[0], three[0]]))
    assert counts(gone) == [1, 1, 2]
    assert counts(gone.insert(keys([three[0], three[0]]))) == counts(index)


def test_a_line_in_a_third_of_all_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    monkeypatch.setattr(line_dedup, "PROBE_LINES", 64)
    docs = spark.createDataFrame([(i, ("hot\n" if i % 3 == 0 else "") + f"pair {i // 2}\nown {i}") for i in range(1500)], "doc_id long, text string")
    index = line_dedup.LineIndex.build(line_dedup.line_keys(docs), 2)
    assert index.shards > 50
    sizes = []
    plain = type(docs).groupBy
    monkeypatch.setattr(type(docs), "groupBy", lambda self, *c: (sizes.append(self) if c == ("shard", "salt") and "d1" in self.columns else None) or plain(self, *c))
    hits = index.hits(line_dedup.line_keys(docs))
    assert hits.count() == 500 + 1500
    assert max(r["count"] for r in plain(sizes[0], "shard", "salt").count().collect()) < 4 * 64


def test_clashing_names_and_folders(spark):
    df = spark.createDataFrame([(i, "same\nown", 1, 2, 3, 4) for i in range(3)], "doc_id long, text string, gone_at int, Text_Lines int, text_hash int, __h int")
    out = line_dedup.dedup_lines(df, 2)
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == df.columns and {r.text for r in out.collect()} == {""}
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)


def test_chunk_places_of_a_long_document():
    lens = np.random.default_rng(3).integers(128, 2048, 40_000).astype(np.int32)
    got = token_store.ids_after(pd.Series([lens, lens[:1], lens[:0]]))
    assert (got[0] == int(lens.sum()) - np.cumsum(lens.astype(np.int64))).all() and got[0][-1] == 0 and got[1].tolist() == [0] and len(got[2]) == 0


def test_words_are_looked_up_once_for_all_texts(monkeypatch):
    """The memo is asked for each distinct part of a piece, not for each place; pieces, cuts inside long texts and empty texts change no ids."""

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    path = public_tokenizers.path("word_bpe_49k.json")
    coder = token_store.Encoder(path)
    monkeypatch.setitem(token_store._tokenizers, path, coder)
    coder.young = Counted()
    texts = ["The cat, the hat. " * 500, "", "\u00e0\u00ed\u00df\u00ff the cat. " * 300, " \n", "\u00c9t\u00e9, cat! don't"] * 2
    assert token_store.encode_words(texts, path) == coder.plain(texts)
    assert Counted.asked <= 10
    monkeypatch.setattr(token_store, "PIECE", 100)
    assert token_store.encode_words(texts, path) == coder.plain(texts)


def test_chunks_end_where_their_own_ids_say():
    """Ends of many lists at once are those of a window rolled over each list alone."""
    rng, kind, mask = np.random.default_rng(4), np.dtype("<u2"), 2**64 - 1
    lists = [rng.integers(0, 49_000, n) for n in (3000, 0, 1, 15, 16, 700, 127, 2500, 128)] + [np.zeros(5000, np.int64)]

    def mixed(i):
        x = (int(i) + 1) * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 32

    def ends_of(ids):
        values, out, last = list(map(mixed, ids)), [], 0
        for p in range(1, len(ids) + 1):
            rolled = sum(v * pow(int(token_store._P), k, 2**64) for k, v in enumerate(reversed(values[max(0, p - token_store.WINDOW) : p]))) & mask
            hit = (rolled >> 40) % (token_store.MEAN - token_store.LEAST) == 0 and p - last >= token_store.LEAST
            if hit or p - last == token_store.MOST or p == len(ids):
                out.append(last := p)
        return out

    assert token_store.cut_points([ids.astype(kind).tobytes() for ids in lists], kind) == list(map(ends_of, lists))


def test_quality_scores_are_the_rules(spark):
    """Scores held against a plain evaluation of the fitted rules, and against a floor on held-out labels."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = [(i, " ".join(word() + ("$$$" if i % 3 == 0 else "") for _ in range(40)), int(i % 3 != 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if i % 2], "doc_id long, quality int")
    model = quality.learned(docs, labels)
    assert model.rules
    scored = quality.statistics(docs, "text").withColumn("score", model.score()).collect()
    compare = {"<=": lambda a, b: a <= b, ">": lambda a, b: a > b}
    for r in scored:
        total = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if all(compare[op](r["__f"][name], at) for name, op, at in rule))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
    held = {i: g for i, _, g in rows if i % 2 == 0}
    got = {r.doc_id: r.predicted for r in quality.classify(docs, model).collect()}
    assert sum(got[i] == g for i, g in held.items()) >= 0.95 * len(held)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.format_chat(none).collect() == []
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.write_store(docs, public_tokenizers.path("word_bpe_49k.json"), 1, str(tmp_path / "store")).documents().collect() == []


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
