import hashlib
import shutil
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfacis.llm import bpe, chat, embed_dedup, fingerprint, jaccard_join, license, line_dedup, mixing, quality, token_store
from surfacis.llm.components import connected

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, ties, a long text, and columns whose names clash with what operators add."""
    rows = [(1, None, None), (2, "", "a"), (3, "  \n\t ", "a"), (4, "The MIT license. " * 3000, "b"), (5, "same words in every copy here now", "b"), (6, "same words in every copy here now", None), (6, "same words in every copy here now", None), (7, "été\nL1\nL1\n\nOne two", "c"), (None, "no id", "c")]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("n_lines", "score", "ids", "h", "at", "size", "component", "packed", "row", "key")})


def test_lines_against_brute_force(spark):
    texts = ["A line\nown %d\n\n a LINE " % i if i % 3 else "x\nown %d" % i for i in range(40)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df, 10).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        keep = [x for x in lines if x.strip().lower() not in ("a line", "x")]
        assert got[i] == (len(lines), len(lines) - len(keep), t if len(keep) == len(lines) else "\n".join(keep))


def test_line_index_is_reversible(spark):
    doc = lambda i: (i, f"shared\nown {i}\ntwo {i // 2}")
    frame = lambda ids: line_dedup.line_keys(spark.createDataFrame([doc(i) for i in ids], "doc_id long, text string"))
    base = line_dedup.LineIndex.build(frame(range(10)), 2)
    moved = base.insert(frame(range(10, 20))).delete(frame(range(10, 20)))
    refs = lambda x: {(r.d1, r.d2): r.n_docs for r in x.refs.collect()}
    assert refs(moved) == refs(base) and len(refs(base)) == 16
    fewer, fresh = base.delete(frame(range(5, 10))), line_dedup.LineIndex.build(frame(range(5)), 2)
    keys = frame(range(10))
    hits = lambda x: {(r.id, r.d1) for r in x.hits(keys, 30).collect()}
    assert hits(fewer) == hits(fresh) and len(hits(fresh)) == 10 + 4 + 1 - 1


def test_cuckoo_filter_deletes_exactly():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63, (2, 5000))
    f = line_dedup.filter_of(a, b)
    assert f.contains(a, b).all()
    f.delete(a, b)
    assert not f.table.any()


def test_chat_round_trip(spark):
    said = [(1, 0, "user", "<|turn|>hi<~|end|> </s>"), (1, 1, "assistant", "[INST]~[/~INST]"), (1, 1, "assistant", None), (2, 0, None, "x"), (None, 0, "assistant", "<~~s>")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat.read_back(chat.format_chat(df)).collect()}
    assert got == {1: ([("user", "<|turn|>hi<~|end|> </s>"), ("assistant", ""), ("assistant", "[INST]~[/~INST]")], "[INST]~[/~INST]"), 2: ([("", "x")], ""), None: ([("assistant", "<~~s>")], "<~~s>")}


def test_chat_parts(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "s3://i", 57, 28, None, None), ("audio", None, "a", None, None, 2.0, None), ("document", None, "d", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chat(df).first()
    assert "see <|image|><|audio|><|document|>" in r.formatted
    assert [tuple(a) for a in r.attachments] == [(0, "image", "s3://i", 3), (0, "audio", "a", 50), (0, "document", "d", 1536)] and r.n_tokens == 1589


def test_fingerprints_estimate_jaccard(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 600)]
    texts = [" ".join(base[: 600 - k] + [f"v{k}{i}" for i in range(k)]) for k in (0, 60, 200, 400)]
    df = fingerprint.fingerprints(spark.createDataFrame([(i, t) for i, t in enumerate(texts + [texts[0], None, "a b"])], "doc_id long, text string"))
    rows = {r.doc_id: r for r in df.collect()}
    assert rows[0].fingerprint == rows[4].fingerprint and len(rows[0].fingerprint) == 512 and rows[5].fingerprint == "" and rows[6].fingerprint
    both = df.alias("a").join(df.alias("b")).where("a.doc_id = 0").select("b.doc_id", fingerprint.likeness(F.col("a.packed"), F.col("b.packed")).alias("like"))
    like = {r.doc_id: r.like for r in both.collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    for i in range(4):
        assert like[i] == pytest.approx(len(sets[0] & sets[i]) / len(sets[0] | sets[i]), abs=0.1)
    assert like[5] == 0.0


def test_token_store_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    store = token_store.write_store(odd, path, 1)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = odd.select("doc_id", "text").collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, [*t.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in rows)
    got = sorted((r.id if r.id is not None else -1, r.ids) for r in store.reconstruct().collect())
    assert got == want and store.verify()
    docs, at = sorted(store.documents().collect(), key=lambda r: r.start), 0
    for r, (i, ids) in zip(docs, want):
        assert (r.id if r.id is not None else -1, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert store.read("chunks").groupBy("key").count().where("count > 1").isEmpty()


def test_damaged_recipes_fail(spark, tmp_path):
    """Swapped keys, swapped lengths, a wrong count and a foreign manifest are told, each in a copy of a sound store."""
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 10**6, 900))) for i in range(3)], "doc_id long, text string")
    store = token_store.write_store(df, public_tokenizers.path("word_bpe_49k.json"), 1, str(tmp_path / "sound"))
    assert store.documents().count() == 3 and store.read("recipes").where("lens <> reverse(lens)").count() == 3
    damage = {"keys": ("recipes", F.reverse("keys")), "lens": ("recipes", F.reverse("lens")), "n_tokens": ("recipes", F.col("n_tokens") + F.col("id") - 1), "root": ("manifest", F.reverse("root"))}
    for column, (name, value) in damage.items():
        path = tmp_path / column
        shutil.copytree(tmp_path / "sound", path, ignore=shutil.ignore_patterns(name))
        store.read(name).withColumn(column, value).write.parquet(f"{path}/{name}")
        with pytest.raises(Exception, match="a recipe|the recipes"):
            token_store.TokenStore(spark, str(path), store.width).documents().collect()


def components(ids, pairs):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, (200, 2))] + [(400 + i, 401 + i) for i in range(40)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = components({x for p in pairs for x in p}, pairs)
    assert all(got.get(i, i) == c for i, c in want.items())


@pytest.mark.parametrize(("words", "p", "q"), [(4, 17, 20), (5, 4, 5)])
def test_jaccard_against_brute_force(spark, words, p, q):
    rng = np.random.default_rng(7)
    texts = [None, "", "one", "One", "a b c d e f"]
    for _ in range(25):
        base = [f"w{i}" for i in rng.integers(0, 400, int(rng.integers(8, 300)))]
        for _ in range(6):
            copy = list(base)
            for i in rng.integers(0, len(base), int(rng.integers(0, max(2, len(base) // 25)))):
                copy[i] = f"x{rng.integers(0, 9)}"
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    pairs = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a and b and q * len(a & b) >= p * len(a | b)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, words, p, q).collect()}
    want = components(range(len(texts)), pairs)
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_block_bound_holds():
    """Linked sets agree in a block: no more blocks differ than elements."""
    rng = np.random.default_rng(9)
    for n in (1, 3, 20, 150, 900):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for _ in range(20):
            drop = int(jaccard_join.most_apart(2 * len(s), 4, 5))
            t = np.unique(np.concatenate((s[: len(s) - drop // 2], rng.integers(0, 2**63, drop // 2).astype(np.uint64))))
            both = len(np.intersect1d(s, t))
            if 5 * both >= 4 * (len(s) + len(t) - both):
                assert len(np.intersect1d(jaccard_join.block_keys(s, 4, 5), jaccard_join.block_keys(t, 4, 5)))


def test_blocks_meet_by_their_elements_alone():
    """Sets without a common element, of sizes that give out no blank block, share no block key, however many there are; near copies do."""
    rng = np.random.default_rng(10)
    sets = [jaccard_join._distinct(jaccard_join._mix(rng.integers(0, 2**63, n).astype(np.uint64))) for n in rng.integers(500, 560, 300)]
    keys = [np.unique(jaccard_join.block_keys(s, 4, 5)) for s in sets]
    assert len(np.unique(np.concatenate(keys))) == sum(map(len, keys))
    assert all(len(np.intersect1d(k, jaccard_join.block_keys(s[:-1], 4, 5))) for s, k in zip(sets, keys))


def test_word_ids_are_those_of_the_library():
    """Combining marks that lower-case letters alone are composed with, strings that are an added token's only when lower-cased, closing punctuation of all kinds; a word is remembered once whatever its case and what closes it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = token_store.Encoder(path)
    texts = ["a <|STARTOFTEXT|> x", "<|EndOfText|>, b", "<|endoftext|> A", "H\u0331 I\u0307. \u0130 A\u030a, Caf\u00e9, CAF\u00c9. \u00c9a! \u03a3\u03a3. \ufb01n, \u01c5. a\u0345.", "x.,* ,a *., a.b. 3.5. 3, A1% d'S, IT'S. 'S. l'ete|", "\u00e9. \u00d7. \u00f7, \u00df! \u00c9t\u00e9, \u00e9t\u00e9,\u00e9 \u00ff*** \u00e9\u0301. na\u00efve \u00aa. \u00b5,", "A.\x1d b \x85 B, C.\u2003c\x0bD!\x0cE?\rF*", "Ab, AB. ab*** aB\nab", "", " "]
    assert token_store.encode_words(texts, path) == coder.plain(texts)
    assert coder.parts("Ab, AB. ab*** aB\nab\u2019") == [b"ab", b",", b"ab", b".", b"ab", b"***", b"ab", "ab\u2019".encode()]
    assert coder.parts("\u00c9t\u00e9, \u00f7,") == ["\u00c9t\u00e9".encode(), b",", "\u00f7,".encode()]
    assert coder.parts("H\u0331.") == ["H\u0331.".encode()]


def test_quality_learns_a_rule(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = [(i, " ".join(word() + ("###" if i % 4 == 0 else "") for _ in range(60)), i % 4 != 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in rows if i % 3], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, quality.learned(docs, labels)).collect()}
    assert sum(got[i].predicted == g for i, _, g in rows) >= 396 and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 402


def test_license_scan(spark):
    body = dict(reversed(license.PASSAGES))["bsd"].split()
    texts = ["Apache License and the MIT-license; mit license", "x y " + " ".join(body[:10] + ["oops"] + body[10:]), None, "", "gnu general public", "CC BY", "GNU General Public License " * 3]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    show = [(got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels) for i in range(len(texts))]
    assert show == [(8, 3, 0, 6, "apache,mit", "apache,mit"), (len(body) + 3, 0, None, None, "", "bsd"), (0, 0, None, None, "", ""), (0, 0, None, None, "", ""), (3, 0, None, None, "", ""), (2, 1, 0, 0, "cc-by", "cc-by"), (12, 3, 0, 8, "gpl", "gpl")]
    assert 0.5 <= got[1].score < 1 and got[0].score == 1.0 and got[2].score == 0.0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 32))
    rows = [base[i % 60] + rng.standard_normal(32) * 0.03 * (i // 60) for i in range(300)] + [base[0] * 2.0, base[0]]
    bad = [None, [0.0] * 32, [float("nan")] * 32, [1.0, None], []]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)] + [(1000 + i, x) for i, x in enumerate(bad)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    x = np.stack(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(len(rows)))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(len(bad))) and len(got) == len(rows) + len(bad)
    assert got[0].component_id == got[300].component_id == got[301].component_id == 0


@pytest.mark.parametrize("tile", [1024, 8])
def test_embedding_components_span_all_links(spark, monkeypatch, tile):
    """A chain and a hub whose ids are in no order, in one bucket, so that all links are found: components are those of the links."""
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    angle = np.arange(15) * np.radians(20)
    chain = np.stack([np.cos(angle), np.sin(angle)], 1) @ np.eye(40)[:2]
    hub = np.concatenate(([np.eye(40)[2]], 0.92 * np.eye(40)[2] + np.sqrt(1 - 0.92**2) * np.eye(40)[3:23]))
    x = np.concatenate((chain, hub, chain[:2]))
    ids = np.random.default_rng(3).permutation(len(x)) + 10
    ids[len(chain)] = 1000
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, tables=2, projections=1, width=1000.0).collect()}
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in np.argwhere(near)])
    assert {i: r.n_links for i, r in got.items()} == dict(zip(ids.tolist(), near.sum(1).tolist()))
    assert {i: (r.component_id, r.kept) for i, r in got.items()} == {i: (c, i == c) for i, c in want.items()} and len(set(want.values())) == 2


def test_bpe_against_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = [None, "", " ", "it's  two  spaces \n\n tab\t.", "été 漢字 😀 ñandú 12345", "a" * 300, "zqxjkvbw" * 8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_documents(df, path, public_tokenizers.PATTERN, dictionary=4).collect():
        t = texts[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(t) and bytes(r.decoded) == t.encode() and bytes(r.ids_packed) == np.array(r.ids, "<u4").tobytes()


def test_mixing(spark):
    assert mixing.targets({"a": 10, "b": 100, "c": 100}, {"a": 5, "b": 2, "c": 1}, 315.0) == {"a": 20.0, "b": pytest.approx(590 / 3), "c": pytest.approx(295 / 3)}
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), [None, "a", "b", "b", "b"][i % 5]) for i in range(500)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == 500 and sorted(got) == sorted(mixing.mix(df).collect())
    for s in (None, "a", "b"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and own[0].source_size == sum(r.size for r in own)
    assert all(r.taken <= 2 * r.size and r.size == len(rows[r.doc_id][1].split()) for r in got)


def test_mixing_truncates_one_queue(spark, monkeypatch):
    """Sources queue whole, and the cut is the total budget: 32 words, not three targets of 10.67 rounded to 33."""
    queued = {}
    monkeypatch.setattr(mixing, "in_ranges", lambda df, order, name, f=mixing.in_ranges: queued.setdefault(name, f(df, order, name)))
    df = spark.createDataFrame([(i, " ".join(["w"] * 4), "abc"[i % 3]) for i in range(24)], DOCS)
    got = mixing.mix(df, weights=(1.0,), share=1 / 3).collect()
    own = {s: sum(r.taken for r in got if r.source == s) for s in "abc"}
    assert sum(own.values()) == 32 and all(abs(n - 32 / 3) < 1 for n in own.values())
    assert queued["mix-queue"].agg(F.sum("words")).first()[0] == 2 * 24 * 4
    far = mixing.mix(df.limit(2), weights=(1.0, 1e-9), share=1.0).collect()
    assert sum(r.taken for r in far) == 8 and mixing.whole({None: 0.4, "a": 7.6}) == {None: 0, "a": 8}


def test_odd_rows_pass_everywhere(spark, odd):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    model = quality.RuleEnsemble([(("symbols", ">", 0.1),)], [-2.0], 1.0)
    runs = [
        lambda d: line_dedup.dedup_lines(d), lambda d: fingerprint.fingerprints(d), lambda d: jaccard_join.jaccard_components(d), lambda d: license.scan(d), lambda d: mixing.mix(d),
        lambda d: quality.classify(d, model), lambda d: bpe.encode_documents(d, ranks, public_tokenizers.PATTERN, dictionary=4), lambda d: fingerprint.with_next(d.select("doc_id", "text"), "doc_id", ["text"]),
    ]
    for run in runs:
        n = run(odd).count()
        assert n in (9, 8) and run(odd.limit(0)).count() == 0  # Jaccard leaves out the row without an id


def test_with_next_wraps_around(spark):
    ids = [5, 1, 9, 3, 7]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(df, "doc_id", ["text"]).collect()}
    assert got == {9: "t7", 7: "t5", 5: "t3", 3: "t1", 1: "t9"}


def test_decoded_digest_is_the_texts(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    r = bpe.encode_documents(spark.createDataFrame([(1, "déjà vu")], "doc_id long, text string"), path, public_tokenizers.PATTERN, dictionary=1).first()
    assert hashlib.sha256(bytes(r.decoded)).digest() == hashlib.sha256("déjà vu".encode()).digest()


def test_lasso_weights_are_optimal():
    rng = np.random.default_rng(5)
    x = (rng.random((600, 12)) < 0.4).astype(np.uint8)
    x[:, 5] = x[:, 4]  # a rule that repeats
    y = (rng.random(600) < 1 / (1 + np.exp(-(2.0 * x[:, 0] - 1.5 * x[:, 1] + 0.2)))).astype(float)
    strength = 0.01
    w = quality.lasso_weights(x, y, strength)
    wide = np.column_stack([x, np.ones(600)])
    slope = wide.T @ (1 / (1 + np.exp(-(wide @ w))) - y) / 600
    used = w[:-1] != 0
    assert 2 <= used.sum() < 12 and abs(slope[-1]) < 1e-6
    assert np.allclose(slope[:-1][used], -strength * np.sign(w[:-1][used]), atol=1e-6)
    assert (np.abs(slope[:-1][~used]) <= strength + 1e-6).all()
