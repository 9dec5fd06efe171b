"""Every registered query and pipeline stage over small tables of odd rows, against brute force where there is one."""

import binascii
import hashlib
import itertools
import re

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from surfacis.llm import bpe, chat, embed_dedup, jaccard_join, license, queries, token_store

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"
PROSE = "the of and to in that was for with his they had not are but from this have an which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people".split()


def words_of(t):
    return [w for w in re.split(f"[{SPACE}]+", t or "") if w]


def texts():
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice(PROSE, n))
    base = [prose(40) for _ in range(12)]
    near = [b + " extra" for b in base[:4]]
    long = prose(6000)
    odd = [None, "", " \n\t ", "one", "One  two\tthree", "a <|endoftext|> b", "İstanbul ﬁ é 漢字 😀", long, long, "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "x" * 3000]
    return base + near + base[:3] + odd


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A folder of tables: documents with ties, copies, nulls and very long texts, and what the stages read besides."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", ["b", "a", None][i % 3], len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1 if len(words_of(t)) > 5 else 0, 0) for i, t in enumerate(texts())], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    said = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "[INST] <~|turn|>"), (2, 0, "assistant", None), (3, 0, "user", "word " * 20000), (3, 1, "assistant", "<|image|>"), (3, 1, "assistant", "<|image|>")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    rng = np.random.default_rng(5)
    v = rng.standard_normal((40, 16)).astype(np.float32)
    vectors = [(i, x.tolist()) for i, x in enumerate(np.concatenate([v, v[:5], v[:6] + 0.02]))] + [(60, None), (61, [0.0] * 16), (62, [float("nan")] * 16), (0, v[9].tolist()), (0, v[9].tolist())]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def by_id(df):
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r for r in rows}


def test_op1(spark, sf_dir, docs):
    keys = {i: [k.strip(SPACE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for k in (r.text or "").split("\n")] for i, r in docs.items()}
    hot = {k for k in set().union(*keys.values()) if k and sum(k in ks for ks in keys.values()) >= 10}
    for i, r in by_id(queries.op1_line_dedup(spark, sf_dir)).items():
        kept = [line for line, k in zip((docs[i].text or "").split("\n"), keys[i]) if k not in hot]
        assert (r.n_lines, r.n_dropped) == (len(keys[i]), len(keys[i]) - len(kept)) and r.kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_op2(spark, sf_dir):
    got = by_id(queries.op2_chat_format(spark, sf_dir))
    assert got[-1].n_turns == 2 and got[-1].loss_chars == 21
    assert got[3].n_turns == 3 and got[3].loss_sha256 == hashlib.sha256(b"<|image|><|image|>").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi </s>\nassistant\n[INST] <~|turn|>\n").hexdigest() and got[2].loss_chars == 0


def test_chat_parts_are_read_back(spark):
    """No attachment can forge a turn, and a placeholder isn't a text that reads like one."""
    part = lambda kind, text=None: (kind, text, "r", None, None, None, None)
    said = [part("text", "keep <|image|>"), part("end"), part("text", "this"), part("image"), part("turn"), part(None)]
    df = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", [part("text", "a"), part("text", "b")])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.read_back(chat.format_chat(df)).first()
    assert [[tuple(p) for p in ps] for ps in r.parts] == [[("text", "keep <|image|>"), ("end", None), ("text", "this"), ("image", None), ("turn", None), ("", None)], [("text", "a"), ("text", "b")]]
    assert r.loss_text == "ab" and len(r.attachments) == 4


def test_op3(spark, sf_dir, docs):
    ids = sorted(docs, reverse=True)
    got = by_id(queries.op3_fingerprint(spark, sf_dir))
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t, n = docs[i].text or "", docs[nxt].text or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and 0 <= got[i].near_edited <= 1
        if t == n:
            assert got[i].fingerprint == got[nxt].fingerprint and got[i].near_next == 1.0


def test_op4(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = by_id(queries.op4_token_store(spark, sf_dir))
    for i in sorted(docs):
        ids = [*t.encode(docs[i].text or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), binascii.crc32(np.array(ids, "<u4").tobytes())), docs[i].text
        start += len(ids)


def test_op4_sees_swapped_chunks(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    store = token_store.write_store(rows, public_tokenizers.path("word_bpe_49k.json"), 1, str(tmp_path / "sound"))
    bad = store.read("recipes").toPandas()
    k = next(i for i, keys in enumerate(bad["keys"]) if len(keys) > 1 and bytes(keys[0]) != bytes(keys[1]))
    bad.at[k, "keys"] = np.array([bad["keys"][k][1], bad["keys"][k][0], *bad["keys"][k][2:]], dtype=object)
    spark.createDataFrame(bad, store.read("recipes").schema).write.parquet(str(tmp_path / "bad" / "recipes"))
    for name in ("chunks", "manifest"):
        store.read(name).write.parquet(str(tmp_path / "bad" / name))
    with pytest.raises(Exception, match="recipe"):
        token_store.TokenStore(spark, str(tmp_path / "bad"), store.width).documents().collect()


def brute_components(sets, p, q):
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) * q >= len(sets[a] | sets[b]) * p:
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {i: root(i) for i in sets}


def shingles(t, k):
    w = words_of((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_op5(spark, sf_dir, docs):
    sets = {i: shingles(r.text, 4) for i, r in docs.items()}
    want = brute_components(sets, 85, 100)
    for i, r in by_id(queries.op5_jaccard_join(spark, sf_dir)).items():
        assert (r.n_shingles, r.component_id) == (len(sets[i]), want[i])


def test_op5_keeps_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "q w e r t y"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in jaccard_join.jaccard_components(df, words=4).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (None, 3, None, False), (None, 0, None, False)], key=str)


def test_op6(spark, sf_dir, docs):
    got = by_id(queries.op6_quality(spark, sf_dir))
    assert set(got) == set(docs)
    assert all(r.held_out == (binascii.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())


def test_op7(spark, sf_dir, docs):
    for i, r in by_id(queries.op7_license_scan(spark, sf_dir)).items():
        w = [x for x in re.split(license.BREAK, (docs[i].text or "").lower()) if x]
        hits = sorted((k, label) for phrase, label in license.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        assert r.n_words == len(w) and r.n_base == len(hits) and r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None)) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_op7_adds_labels_and_verifies_order(spark):
    grant = license.PASSAGES[0][1].split()
    mixed = " ".join(x for k in range(0, len(grant) - 8, 8) for x in grant[k + 4 : k + 8] + grant[k : k + 4])
    df = spark.createDataFrame([(1, "x " + " ".join(grant) + " y"), (2, mixed), (3, "licensed under CC BY-NC 4.0"), (4, " ".join(grant[:20] + ["oh"] + grant[20:]))], "doc_id long, text string")
    got = {r.doc_id: r for r in license.scan(df).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0 and got[2].labels == "" and got[3].labels == "cc-by,cc-by-nc-4.0" and got[4].labels == "mit"


def test_op8(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = [np.array(r.embedding, float) if r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding) else None for r in rows]
    near = [[i != j and a is not None and b is not None and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9 for j, b in enumerate(x)] for i, a in enumerate(x)]
    comp = list(range(len(x)))
    for _ in x:
        comp = [min([comp[i], *(comp[j] for j in range(len(x)) if near[i][j])]) for i in range(len(x))]
    least = {c: min(rows[i].vec_id for i in range(len(x)) if comp[i] == c) for c in set(comp)}
    want = sorted((r.vec_id, sum(near[i]), least[comp[i]]) for i, r in enumerate(rows))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in queries.op8_embedding_dedup(spark, sf_dir).collect()) == want


def test_op8_recall_at_the_border(spark):
    rng, d, n = np.random.default_rng(11), 64, 1500
    a = rng.standard_normal((n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, d))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.905, (n, 1)) + 1e-9
    pairs = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(pairs)], "vec_id long, embedding array<double>")).collect()}
    assert sum(got[i + n].component_id == i for i in range(n)) / n >= 0.9


def test_op9(spark, sf_dir, docs):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, r in by_id(queries.op9_byte_bpe(spark, sf_dir)).items():
        ids = enc.encode_ordinary(docs[i].text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256((docs[i].text or "").encode()).hexdigest()


def test_op10(spark, sf_dir, docs):
    got = by_id(queries.op10_mixing(spark, sf_dir))
    size = {i: len(words_of(r.text)) for i, r in docs.items()}
    own = {s: sum(size[i] for i in docs if docs[i].source == s) for s in ("a", "b", None)}
    left, free, target = 1.5 * sum(own.values()), {"a": 5, "b": 2, None: 1}, {}
    while free:
        unit = left / sum(free.values())
        full = [s for s in free if unit * free[s] > 2 * own[s]]
        target |= {s: 2.0 * own[s] for s in full} if full else {s: unit * w for s, w in free.items()}
        left, free = left - sum(target[s] for s in full), {s: w for s, w in free.items() if s not in full} if full else {}
    for s in own:
        rows = [r for r in got.values() if docs[r.doc_id].source == s]
        assert all(r.size == size[r.doc_id] and r.source_size == own[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - target[s]) <= 1


def test_pipeline(spark, sf_dir):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(enc.decode_bytes(r.ids)).hexdigest() for r in rows)


def test_stages_on_odd_rows(spark, sf_dir):
    """Null and shared ids, null columns, ties and repeated rows, extra columns of clashing names; and an empty table. The eight words and the nine share four of five shingles, so they link."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    rows = [(None, a, "en", None, 1, 9), (None, a, "en", None, 1, 9), (None, b, None, "s", None, 9), (5, b + " nine", "en", "s", 1, 9), (5, "quite another text that is kept as it shares an id only", "en", "s", 1, 9), (6, None, None, None, None, 9), (7, "", "en", "s", 0, 9)]
    odd = spark.createDataFrame(rows, DOCS + ", size long")
    columns = corpus_pipeline.COLUMNS
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf_dir)
        assert name == "tokens" or got.columns == columns
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
        if name == "lines" or name == "tokens":
            assert got.count() == len(rows)
        if name == "near_duplicates":
            assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted([("None", a), ("5", b + " nine"), ("5", rows[4][1]), ("6", ""), ("7", "")])
