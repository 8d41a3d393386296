"""Token alignment, vector codes and exact dedupe against brute force, and on odd tables."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from huntspark.llm import alignment, exact_dedup, queries, vector_codes

SF = "/root/testdata/sf0.001"
A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
COLUMNS = "doc_id bigint, text string, sha string, mark bigint, block int, label string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ODD = [(1, "same  text"), (2, "same text"), (3, "same\n\ttext"), (4, ""), (5, None), (6, " "), (7, " \t\n"), (8, LONG), (9, LONG.replace(" ", "\n\n")), (10, "zażółć 漢字 😀  x"), (None, "same text"),
       (None, "nobody's"), (None, "nobody's"), (11, "twice"), (11, "twice"), (11, "other"), (12, "<|endoftext|> <s> </s> <0x41> x"), (13, "a▁b"), (14, "same text"), (15, "x\u0000y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "s", 1, 2, "l") for r in ODD], COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


# 11 --------------------------------------------------------------------------
@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()

    def one(text):
        ids = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        spelt = ([bytes(alphabet[c] for c in first.id_to_token(i)) for i in ids[0]],
                 [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelt):
            return [], [], [], []
        at = [np.cumsum([len(t) for t in s]).tolist() for s in spelt]
        links = [(i, j) for i, a in zip(ids[0], at[0]) for j, b in zip(ids[1], at[1]) if a == b] if len(ids[0]) < 200 else [(ids[0][at[0].index(e)], ids[1][at[1].index(e)]) for e in sorted(set(at[0]) & set(at[1]))]
        groups, low = [], 0
        for cut in sorted(set(at[0]) & set(at[1])):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids[k], at[k]) if low < e <= cut) for k in (0, 1)))
            low = cut
        return ids[0], ids[1], groups, links

    return one


def plain_table(texts, plain):
    each = [plain(t or "") for t in texts]
    counts = Counter(p for *_, links in each for p in links)
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(len(a), len(b), len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for a, b, g, links in each]


def rows_of(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("slice_bytes,block_bytes", [(2_000_000, 8_000_000), (2_000, 7_000)])
def test_alignment_equals_brute_force(spark, plain, slice_bytes, block_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 6000").orderBy("doc_id")
    texts = [r.text for r in docs.collect()]
    assert len(texts) > 100
    assert rows_of(alignment.linked(docs.repartition(3), A, B, slice_bytes=slice_bytes, block_bytes=block_bytes)) == plain_table(texts, plain)


def test_alignment_of_odd_tables(spark, odd, none, plain):
    texts = [t for _, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)) if t != LONG and (t or "").replace("\n\n", " ") != LONG]
    got = rows_of(alignment.linked(odd.filter("length(text) < 1000 OR text IS NULL"), A, B))
    assert sorted(got) == sorted(plain_table(texts, plain)) and (0, 0, 0, 0, 0, 0, "") in got
    assert alignment.linked(odd, A, B).count() == len(ODD)
    assert alignment.linked(none, A, B).count() == 0


def test_alignment_of_random_texts(plain):
    draw = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "漢", "😀", "▁", "<s>", "<|endoftext|>", "ing", "The", ".", "'s", "12", "\r", "\x00", "̈", "ﬁ", "<0x41>", "​"]
    texts = [None, "", " ", "a ", " a"] + ["".join(draw.choices(parts, k=draw.randint(1, 25))) for _ in range(800)]
    table, pairs = alignment.aligned(pa.array(texts, pa.large_string()), *alignment.vocabularies(A, B))
    want = [plain(t or "") for t in texts]
    assert table.column("groups").to_pylist() == [";".join(w[2]) for w in want]
    assert pairs.to_pylist() == [i << 32 | j for w in want for i, j in w[3]]


# 12 --------------------------------------------------------------------------
def plain_codes(rows, parts, entries, rounds):
    """All in whole numbers, entry by entry."""
    rows = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    at = vector_codes.bounds(len(rows[0][1]), parts)
    cut = lambda v: [v[a:b] for a, b in zip(at, at[1:])]
    books = [list(p) for p in zip(*(cut(v) for _, v, _ in rows[:entries]))]
    nearest = lambda book, s: min((sum((a - b) ** 2 for a, b in zip(s, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = defaultdict(list)
            for _, v, _ in rows:
                held[nearest(book, cut(v)[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(held[i]) for c in zip(*held[i])] if i in held else e for i, e in enumerate(book)]
    out, by_label = [], Counter()
    for i, v, label in rows:
        found = [nearest(b, s) for b, s in zip(books, cut(v))]
        out.append([i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label])
        by_label[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, by_label[label], sha) for i, code, error, label in out]


def codes_of(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_codes_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").limit(150)
    want = plain_codes([(r.vec_id, r.embedding, r.label) for r in rows.collect()], 16, 64, 2)
    assert codes_of(vector_codes.coded(rows.repartition(4))) == sorted(want, key=str) and len(want) == 150


@pytest.mark.parametrize("spread", [0.02, 1.0, 3e4, 1e12, 1e37])
def test_codes_of_ties_and_huge_numbers(spark, spread):
    draw = np.random.default_rng(7)
    rows = [(i if i % 11 else None, [float(np.float32(x)) for x in draw.integers(-3, 4, 8) * spread], "abc"[i % 3] if i % 5 else None) for i in range(80)]
    rows += rows[:7] + [(900, None, "a"), (901, [1.0, None, *[0.0] * 6], "a"), (902, [float("nan")] * 8, None), (903, [float("inf")] * 8, "b"), (904, [], "b")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label string, part int, salt string")
    want = plain_codes(rows, 4, 8, 2)
    if spread > 1e9:  # errors that exceed 64 bits are NULL
        lost = {w[3] for w in want if w[2] >= 1 << 63 or w[3] >= 1 << 63}
        want = [(i, c, e if e < 1 << 63 else None, None if s in lost else s, h) for i, c, e, s, h in want]
    assert codes_of(vector_codes.coded(df, parts=4, entries=8)) == sorted(want, key=str)


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert vector_codes.coded(empty).count() == 0 and vector_codes.trained(vector_codes.kept(empty).select("vec_id", F.col("embedding").alias("vector"))) == []
    ragged = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0], 1), (3, [1.0, 2.5], None)], "vec_id bigint, embedding array<double>, label int")
    assert [r[0] for r in codes_of(vector_codes.coded(ragged, parts=2))] == [1, 3]
    (one,) = vector_codes.coded(ragged.filter("vec_id = 1")).collect()  # fewer components than parts: empty parts cost nothing
    assert one.code == "00" * 16 and one.error == 0


def test_gnat_leaves_out_subtrees_and_finds_the_same():
    draw = np.random.default_rng(3)
    for width, spread in ((4, 200), (2, 3), (1, 4), (8, 10**7), (4, 2**28)):
        entries, asked = draw.integers(-spread, spread + 1, (64, width)), draw.integers(-spread, spread + 1, (3000, width))
        entries[40] = entries[7]
        index, apart = vector_codes.Codebook(entries.tolist()).nearest(asked)
        full = vector_codes.squared(asked, entries)
        assert (index == full.argmin(axis=1)).all() and (apart == full.min(axis=1)).all()
    tree, best = vector_codes.Gnat(draw.integers(-200, 200, (64, 3))), np.full(3000, np.iinfo(np.int64).max)
    assert tree.search(draw.integers(-200, 200, (3000, 3)), np.arange(3000), best, np.full(3000, 64)) < 0.6 * 64 * 3000


# 13 --------------------------------------------------------------------------
def plain_groups(rows):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    held = defaultdict(list)
    for i, t in rows:
        held[body(t)].append(i)
    out = []
    for b, ids in held.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), n == 0, hashlib.sha256(b.encode()).hexdigest()) for n, i in enumerate(ids)]
    return sorted(out, key=str)


def groups_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_dedup_equals_brute_force(spark, odd, batches):
    assert groups_of(exact_dedup.deduplicated(odd, batches=batches)) == plain_groups(ODD)


def test_dedup_of_documents_and_hot_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    hot = spark.range(10_000, 13_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "one  text").otherwise("one text").alias("text"))
    both = docs.unionByName(hot).repartition(6)
    assert groups_of(exact_dedup.deduplicated(both, batches=3)) == plain_groups([(r.doc_id, r.text) for r in both.collect()])


def test_dedup_of_an_empty_table(spark, none):
    assert exact_dedup.deduplicated(none).count() == 0


def test_snapshots_know_what_older_ones_hold(spark, tmp_path):
    old, new = ([(i, f"text  {i}") for i in range(a, b)] for a, b in ((0, 500), (400, 1500)))
    for name, rows in (("old", old), ("new", new)):
        exact_dedup.snapshot(spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / name), per_bucket=50)
    through = {r.mark for r in exact_dedup.positives(spark, str(tmp_path / "new"), str(tmp_path / "old")).collect()}
    assert 100 <= len(through) < 130  # nothing is missed, and hardly anything new is let through
    found = exact_dedup.known(spark, str(tmp_path / "new"), str(tmp_path / "old")).collect()
    assert sorted(r.keep_id for r in found) == list(range(400, 500))


def test_equal_digests_of_different_texts_stay_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_mark", lambda sha: F.lit(7).cast("bigint"))
    rows = [(i, f"text {i % 5}") for i in range(20)]
    assert groups_of(exact_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"))) == plain_groups(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_filters_hold_every_key(n):
    draw = np.random.default_rng(n)
    keys = np.unique(draw.integers(-2**63, 2**63 - 1, n, dtype=np.int64))
    made = exact_dedup.fuse(keys)
    assert exact_dedup.maybe(keys, *made).all()
    assert exact_dedup.maybe(draw.integers(-2**63, 2**63 - 1, 50_000, dtype=np.int64), *made).mean() < 0.01
    assert n < 1000 or len(made[3]) < 1.5 * n


# Limits that earlier operators had ---------------------------------------------
def test_url_trees_are_as_deep_as_their_branches(spark):
    rows = [(i, f"http://h.example/a/b/c/d/e/{'good' if i % 2 else 'bad'}/{i}", i % 2) for i in range(400)] + [(1000 + i, f"http://h.example/x/{i}/" + "y/" * i, 1) for i in range(30)]
    from huntspark.llm import url_templates

    pages = spark.createDataFrame([(i, u, 1 - g) for i, u, g in rows], "page_id long, url string, bad int")
    got = {r.page_id: (r.template, r.verdict) for r in url_templates.judged(pages, [], label="bad").collect()}
    assert all(got[i] == (f"/a/b/c/d/e/{'good' if i % 2 else 'bad'}/*", "allow" if i % 2 else "block") for i in range(400))
    assert got[1005][0].count("/") == rows[405][1].removeprefix("http://h.example").count("/")


def test_every_turn_is_kept(spark):
    from huntspark.llm import chat

    turns = spark.createDataFrame([(1, None, "user", "ok"), (1, None, "assistant", "yes"), (1, None, "user", "ok"), (1, None, "assistant", "fine")], "conv_id int, turn int, role string, text string")
    got = [r.text for r in chat.repaired(turns).collect() if r.action != "insert"]
    assert sorted(got) == ["fine", "ok", "ok", "yes"]
