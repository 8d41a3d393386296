"""The training-data operators against brute force, and on odd tables."""
import base64
import hashlib
import itertools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from huntspark.llm import chat, common, fingerprints, jaccard_join, kneser_ney, mixing, packing, queries, range_coder, shingles, token_files, tokens, url_templates, vectors, warc

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
NEAR = BASE.replace("alpha30", "changed")
#: NULLs in every column, empty, blank and very long texts, repeated ids and rows, extra columns.
ODD = [
    (1, BASE, "en", "a", 5), (2, NEAR, "en", "a", 5), (3, BASE.upper(), None, "b", 5), (4, "", "en", None, 0), (5, None, "en", "b", None), (6, " \t\n", "de", "é", 3), (7, LONG, "en", "a", len(LONG)),
    (8, "one two", "en", "b", 7), (9, "ONE two", "fr", "b", 7), (10, "zażółć 漢字 😀 \u00a0x", "pl", "𐍈", 9), (None, "no id here", "en", "a", 10), (11, "twice", "en", "a", 5), (11, "twice", "en", "a", 5),
    (12, "same id one", "en", "b", 11), (12, "same id two and more words than that", "en", "b", 11), (13, "<|endoftext|> WARC/1.0\r\n", "en", "a", 20)]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, i, "x", 1.5) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, COLUMNS + ", draws bigint, gram string, id double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return WORDS.findall(text or "")


# 1 ---------------------------------------------------------------------------
PAGES = [(i, f"http://x/{i}", h) for i, h in enumerate([
    "a", "b", "a", None, "", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n", "é\r\n\r\nWARC/1.0\r\n", "x" * 200_000, "\r\n\r\n", "WARC/1.0\r\n"])]
PAGES += [(None, "u", "a"), (3, None, "other text, same id"), (50, "u 1\n", "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n")]
PAGES += [(100 + i, "u", "WARC/1.0\r\n" * (i % 7) + "z" * i * 13) for i in range(60)]


@pytest.mark.parametrize("per_file,block,split", [(20_000, 64 << 20, "128m"), (20, 300, "1k")])
def test_warc_round_trip(spark, tmp_path, per_file, block, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("line", F.lit(1)).coalesce(1)
        warc.write(warc.records(pages), str(tmp_path / "w"), per_file)
        got = warc.read(spark, str(tmp_path / "w"), block).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for i, u, h in sorted(PAGES, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        first.setdefault(h or "", (i, u))
    assert len(got) == len(PAGES)
    for i, u, h in PAGES:
        name, sha = f"<urn:page:{'null' if i is None else i}>", base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        (r,) = [g for g in got if g.record_id == name and g.payload_digest == sha]
        if first[h or ""] == (i, u):
            assert r.record_type == "response" and bytes(r.payload) == (h or "").encode()
        else:
            assert r.record_type == "revisit" and bytes(r.payload) == b"" and r.refers_to == f"<urn:page:{first[h or ''][0]}>"


def test_warc_without_pages(spark, tmp_path):
    warc.write(warc.records(spark.createDataFrame([], "page_id bigint, url string, html string")), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def test_short_payloads_are_always_responses(spark):
    heads = [bytes(r.value) for r in warc.records(spark.createDataFrame([(1, "", "ab"), (2, "", "ab"), (3, "", "abcd"), (4, "", "abcd")], "page_id int, url string, html string"), revisit_from=3).collect()]
    assert sum(b"WARC-Type: revisit" in h for h in heads) == 1


# 2 ---------------------------------------------------------------------------
def plain_sketch(text, width=fingerprints.WIDTH):
    return {tuple(text[i:i + width]) for i in range(max(1, len(text) - width + 1))} if text else set()


def test_fingerprints_follow_the_order_and_the_edit(spark, docs):
    got = {r.doc_id: r for r in fingerprints.fingerprinted(docs).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert len(got) == len(rows)
    errors = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        edited = t[:len(t) - k] + after[:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = plain_sketch(t), plain_sketch(edited)
        if len(a) > 400:
            errors.append(abs(got[i].near_edited - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.05 and max(errors) < 0.25


def test_sketches_merge_and_contain():
    a, b = "".join(chr(97 + i * i % 26) + str(i) for i in range(4000)), "".join(chr(97 + i * 7 % 26) + str(i * 3) for i in range(200))
    (sa, sb, sab, again) = fingerprints.sketches([a, b, a + "\u0000" * 30 + b, a])
    assert (sa == again).all() and fingerprints.packed(sa) == fingerprints.packed(again) and (fingerprints.unpacked(fingerprints.packed(sa)) == sa).all()
    assert fingerprints.containment(sb, sab) > 0.95 and fingerprints.containment(sa, fingerprints.merged(sa, sb)) == 1
    assert abs(len(sa) / (len(a) - fingerprints.WIDTH + 1) - fingerprints.FRACTION) < 0.02
    assert [len(x) for x in fingerprints.sketches(["", "a", "ab"])] == [0, 1, 1]


def test_fingerprints_of_odd_tables(spark, odd, none):
    rows = fingerprints.fingerprinted(odd).collect()
    assert sorted(r.n_chars for r in rows) == sorted(len(r[1] or "") for r in ODD)
    assert len({r.fingerprint for r in rows if r.doc_id == 11}) == 1
    assert fingerprints.fingerprinted(none).count() == 0
    (one,) = fingerprints.fingerprinted(odd.filter("doc_id = 8")).collect()
    assert one.near_next == 1.0


# 3 ---------------------------------------------------------------------------
def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = total - sum(stopped.values())
        free = [s for s in names if s not in stopped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {**stopped, **share}
        stopped.update({s: 3.0 * sizes[s] for s in over})


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix_meets_its_targets(request, which):
    table = request.getfixturevalue(which)
    rows = mixing.planned(table, block_words=500, blocks_per_shard=4).collect()
    assert len(rows) == table.count()
    sizes, taken = {}, {}
    for r in rows:
        assert r._mix_size == len(words(r.text))
        own = sum(t.words for t in r._mix_takes)
        assert own <= 3 * r._mix_size and len({t.epoch for t in r._mix_takes}) == len(r._mix_takes)
        sizes[r.source] = sizes.get(r.source, 0) + r._mix_size
        taken[r.source] = taken.get(r.source, 0) + own
    want = plain_targets(sizes)
    for r in rows:
        assert r._mix_target == pytest.approx(want[r.source]) and r._mix_total == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3
    again = {(r.doc_id, r.text): r._mix_takes for r in mixing.planned(table, block_words=500, blocks_per_shard=4).collect()}
    assert again == {(r.doc_id, r.text): r._mix_takes for r in rows}


def test_mixed_rows_are_the_takes(odd, none):
    plan = mixing.planned(odd, block_words=50).collect()
    out = mixing.mixed(odd, block_words=50).collect()
    assert len(out) == sum(len(r._mix_takes) for r in plan) and out[0].__fields__ == odd.columns
    assert sum(len(words(r.text)) for r in out) == sum(t.words for r in plan for t in r._mix_takes)
    assert mixing.mixed(none).count() == 0 and mixing.planned(none).count() == 0


def test_hypergeometric_and_tree(spark):
    rows = spark.range(20_000).select(mixing.hypergeometric(F.lit(60).cast("bigint"), F.lit(25).cast("bigint"), F.lit(20).cast("bigint"), common.uniform(F.lit(1), "id")).alias("k")).collect()
    k = np.array([r.k for r in rows])
    assert abs(k.mean() - 20 * 25 / 60) < 0.05 and abs(k.var() - 20 * 25 / 60 * 35 / 60 * 40 / 59) < 0.1
    quotas = spark.createDataFrame([(0, 700), (1, 250), (2, 51)], "place int, quota long")
    got = mixing.split_tree(quotas, 1001, 13, 5).collect()
    assert {p: sum(r["count"] for r in got if r.place == p) for p in range(3)} == {0: 700, 1: 250, 2: 51}
    assert sorted({sum(r["count"] for r in got if r.shard == s) for s in range(13)}) == [77]


# 4 ---------------------------------------------------------------------------
def test_url_parts_and_rules(spark):
    rules = (("allow", "net", "/"), ("block", "a.net", "/x/"), ("block", "com", "/de/"))
    urls = ["http://A.Net/x/1", "https://b.a.net/x/", "http://a.net", "xa.net/x/", None, "", "http://ba.net/x/1?y=/q#z", "ftp://q.COM/de/7#f", "http://é.com?x/de/", "http://u://v/w", "http://c.net/x/\n1"]
    want = [("a.net", "/x/1", "a.net/x/", "block"), ("b.a.net", "/x/", "a.net/x/", "block"), ("a.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
            ("ba.net", "/x/1", "net/", "allow"), ("q.com", "/de/7", "com/de/", "block"), ("é.com", "", None, "allow"), ("u:", "//v/w", None, "allow"), ("c.net", "/x/\n1", "net/", "allow")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, None, None)], "page_id int, url string, host string")
    got = [tuple(r) for r in url_templates.judged(pages, rules).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    # Without a rule the templates decide; here most labels are bad.
    assert [g[:3] for g in got[1:]] == [w[:3] for w in want] and all(g[3] == w[3] for g, w in zip(got[1:], want) if w[2])
    assert url_templates.judged(pages.limit(0), rules).count() == 0


def test_templates_split_by_label(spark):
    rows = [(f"http://h.x/good/{i}", 0) for i in range(40)] + [(f"http://h.x/bad/{i}", 1) for i in range(40)] + [(f"http://h.x/{w}/{i}", None) for w in ("good", "bad") for i in range(5)] + [("http://h.x/a/b/c/d/e/f", None)]
    got = url_templates.judged(spark.createDataFrame(rows, "url string, y int"), (), label="y").collect()
    assert {(r.template, r.verdict) for r in got} == {("/good/*", "allow"), ("/bad/*", "block"), ("/*/*/*/*/*/*", [r.verdict for r in got if r.url.endswith("f")][0])}


# 5 ---------------------------------------------------------------------------
def plain_ids(texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(name))
    t.encode_special_tokens = True
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_pieces_are_the_ids_of_texts(name):
    import random

    import pyarrow as pa

    random.seed(5)
    marks = ["a", "B", " ", "\n", "é", "\u00a0", "中", "\u3000", "'s", "1", "!", "😀", "\u0301", "\r", "\u0085", "ß", "  ", ".", ",", "Σ"]
    texts = ["".join(random.choice(marks) for _ in range(random.randint(0, 30))) for _ in range(1500)] + [r[1] for r in ODD]
    got = [part.tolist() for _, ids, n in tokens.encoded(pa.array(texts), queries.vocabulary(name), 2) for part in np.split(ids, np.cumsum(n)[:-1])]
    assert got == plain_ids(texts, name)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_special_strings_are_the_librarys(name):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    random.seed(7)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", "<|", "a", "B", " ", "\n", "  ", "é", "\u0301", "中", "'s", "1", ".", "ß"]
    texts = ["".join(random.choice(marks) for _ in range(random.randint(0, 20))) for _ in range(1500)] + ["x <|endof", "text|> y", "<|endoftext|>"] + [r[1] or "" for r in ODD]
    plain = Tokenizer.from_file(queries.vocabulary(name))
    want = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    got = [part.tolist() for _, ids, n in tokens.encoded(pa.array(texts), queries.vocabulary(name), 2, special=True) for part in np.split(ids, np.cumsum(n)[:-1])]
    assert got == want


def test_queries_give_special_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["one <|endoftext|> two", "<|startoftext|>three"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query, column, name in ((queries.op5_binary_packing, "doc_tokens", "word_bpe_49k.json"), (queries.op9_mixed_range_coder, "n_tokens", "byte_bpe_50k.json")):
        plain = Tokenizer.from_file(queries.vocabulary(name))
        got = {r.doc_id: r[column] for r in query(spark, str(tmp_path)).collect()}
        assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_pieces_rebuild_the_documents(odd, none):
    rows = packing.packed(odd, queries.vocabulary("word_bpe_49k.json"), longest=64).collect()
    want = sorted((r[0] or 0, ids) for r, ids in zip(ODD, plain_ids([r[1] for r in ODD], "word_bpe_49k.json")))
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and len(r.ids) == 4 * r.length for r in rows)
    found, at = [], []
    for r in rows:  # pieces of a document follow each other
        if r.start == 0:
            at = []
            found.append((r.doc_id or 0, at))
        assert len(at) == r.start
        at += np.frombuffer(r.ids, "<u4").tolist()
        assert len(at) <= r.doc_tokens
    assert sorted(found) == want
    assert packing.packed(none, queries.vocabulary("word_bpe_49k.json")).count() == 0


# 6 ---------------------------------------------------------------------------
def test_search_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, r.embedding) for r in rows]
    rows += [(1000 + i, rows[3][1]) for i in range(50)] + [(2000, None), (2020, [0.0] * 64), (2040, [None] + [1.0] * 63), (2060, [float("nan")] * 64), (2080, [1.0]), (None, rows[4][1]), (rows[5][0], rows[5][1])]
    got = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, list_rows=40, shard_rows=100, block_rows=60, sample_rows=300).collect()
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v)}
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in ok if i % 20 == 0}
    hit = 0
    for q, mine in found.items():
        best = sorted(((-float(np.cumsum(ok[q] * v)[-1]), i) for i, v in ok.items() if i != q))[:20]
        mine.sort()
        assert [r for r, _, _ in mine] == list(range(1, 21)) and [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        assert all(s == pytest.approx(float(ok[q] @ ok[i]), abs=1e-12) for _, i, s in mine)
        hit += len({i for _, i in best} & {i for _, i, _ in mine})
    assert hit / (20 * len(found)) >= 0.9


def test_search_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vectors.nearest(few, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.0), (20, 1, 1, 2.0), (20, 2, 0, 1.0)]
    assert vectors.nearest(few.limit(0), F.lit(True)).count() == 0 and vectors.nearest(few.limit(0), F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]


# 7 ---------------------------------------------------------------------------
def plain_kneser_ney(train, order):
    """Probability of a gram, by the textbook recursion."""
    pad = kneser_ney.START * (order - 1)
    counts = {order: {}}
    for t in train:
        for i in range(len(t)):
            g = (pad + t)[i:i + order]
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    cut = {}
    for k, c in counts.items():
        n = [sum(1 for v in c.values() if v == i) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        cut[k] = [min(max(x, 0.05), i) for i, x in enumerate(d, 1)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        same = {h: c for h, c in counts[k].items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total, off = sum(same.values()), lambda c: cut[k][min(c, 3) - 1]
        own = max(same.get(g, 0) - off(same[g]), 0) / total if g in same else 0
        return own + sum(off(c) for c in same.values()) / total * p(g[1:])

    return p


def test_perplexity_is_the_textbooks(spark):
    train = ["abracadabra", "alakazam abra", "hocus pocus cadabra", "", "été"]
    texts = ["abra cadabra", "zzz", "", None, "hocus", "a"]
    p = plain_kneser_ney(train, 3)
    model = kneser_ney.Model(kneser_ney.gram_counts(spark.createDataFrame([(t,) for t in train], "text string"), "text", 3), 3)
    got = {r.doc_id: r for r in kneser_ney.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()}
    for i, t in enumerate(texts):
        want = -np.mean([np.log(p((kneser_ney.START * 2 + t)[j:j + 3])) for j in range(len(t))]) if t else None
        assert got[i].n == len(t or "") and (got[i].log_perplexity == pytest.approx(want, rel=1e-5) if t else got[i].log_perplexity is None)
    assert sum(p("ab" + c) for c in set("".join(train))) == pytest.approx(1, abs=0.02)


def test_quality_on_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r.keep for r in queries.op7_kneser_ney(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    clean = [got[r.doc_id] for r in labels if r.quality == 1 and r.toxic == 0]
    junk = [got[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.25


JUNK = (("repeated word", r"(\b\w+)( \1){4}"), ("symbols", r"###|\$\$\$|%%%|&&&|\*\*\*"), ("bars", r" \| "), ("shouting", "!!"))


def test_quality_by_kind_of_junk(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r.keep for r in queries.op7_kneser_ney(spark, d).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    junk = [r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").filter("quality = 0").collect()]
    kinds: dict = {}
    for i in junk:
        kinds.setdefault(next((k for k, p in JUNK if re.search(p, texts[i])), "other"), []).append(got[i])
    assert all(not any(kinds[k]) for k in ("symbols", "bars", "shouting")), kinds
    assert np.mean(kinds["repeated word"]) < 0.25 and np.mean([got[i] for i in junk]) < 0.05


def test_quality_of_odd_tables(spark, odd, none):
    got = kneser_ney.judged(odd, spark.createDataFrame([(1,), (2,), (None,)], "doc_id long")).collect()
    assert len(got) == len(ODD) and all(r.keep for r in got if r.lang != "en" or r.doc_id in (1, 2, 4, 5))
    nobody = spark.createDataFrame([], "doc_id long")
    assert all(r.keep for r in kneser_ney.judged(odd, nobody).collect()) and kneser_ney.judged(none, nobody).count() == 0


# 8 ---------------------------------------------------------------------------
def plain_groups(rows):
    sets = []
    for _, t in rows:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("block", [512, 4])
def test_components_match_brute_force(spark, monkeypatch, block):
    import random

    random.seed(8)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = [(r[0], r[1]) for r in ODD]
    words_of = [f"v{i}" for i in range(300)]
    common_part = " ".join(f"shared{i}" for i in range(60))
    for g in range(12):
        seed = [random.choice(words_of) for _ in range(random.randint(5, 150))]
        for c in range(random.randint(1, 14)):
            copy = [random.choice(words_of) if random.random() < 0.02 else w for w in seed]
            rows.append((1000 + 50 * g + c, " ".join(copy) + (" " + common_part if g % 3 == 0 else "")))
    got = jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in got) == plain_groups(rows)


def test_components_of_nothing(none):
    assert jaccard_join.near_groups(none).count() == 0


def test_word_sets_of_batches():
    import pyarrow as pa

    texts = ["A b c d e f", "a B c d e", None, "", "  a\tb\x0b", "x" * 100 + " é É"] * 700
    sizes = [int(n) for _, _, bounds in shingles.sets(pa.array(texts)) for n in np.diff(bounds)]
    assert sizes == [2, 1, 0, 0, 1, 1] * 700


# 9 ---------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 5, 2047, 2048, 2049, 6000])
@pytest.mark.parametrize("vocabulary", [3, 50_258, 1_000_000])
def test_coder_round_trip(n, vocabulary):
    rng = np.random.default_rng(n + vocabulary)
    for ids in (rng.integers(0, vocabulary, n), np.minimum(vocabulary - 1, rng.pareto(0.7, n) * 3).astype(np.int64), np.resize(rng.integers(0, vocabulary, 40), n)):
        coded = range_coder.encode_blocks(ids, vocabulary)
        assert (range_coder.decode_blocks(coded, n, vocabulary) == ids).all()
    if n == 6000:  # repeats are predicted
        assert sum(map(len, coded)) < 0.3 * n * 2


def test_token_files(spark, odd, none, tmp_path):
    path = str(tmp_path / "t")
    token_files.write(odd, path, queries.vocabulary("byte_bpe_50k.json"), block=16, lanes=8)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or ""), ids) for r, ids in zip(ODD, plain_ids([r[1] for r in ODD], "byte_bpe_50k.json")))
    start = 0
    for r, ((some, i, _), ids) in zip(got, rows, strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (i if some else None, start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    token_files.write(none, str(tmp_path / "n"), queries.vocabulary("byte_bpe_50k.json"))
    assert token_files.read(spark, str(tmp_path / "n")).count() == 0


def test_damage_is_noticed():
    ids = np.arange(5000) % 700
    data = bytearray(token_files.frame(0, 0, np.array([1]), np.array([False]), np.array([5000]), ids, 65_536, 512))
    assert (token_files.unframe(bytes(data))[5] == ids).all()
    for at in (10, len(data) - 20):
        hurt = data.copy()
        hurt[at] ^= 0x55
        with pytest.raises(token_files.DamagedBlock):
            token_files.unframe(bytes(hurt))


# 10 --------------------------------------------------------------------------
def cheapest(roles):
    best = np.inf

    def go(i, state, cost):
        nonlocal best
        if i == len(roles):
            best = min(best, cost + chat.END[state])
            return
        for price, start, to, _, _ in chat.MOVES[roles[i]]:
            if start == state:
                go(i + 1, to, cost + price)

    go(0, chat.START, 0)
    return best


def test_repairs_are_cheapest_and_legal():
    for n in range(5):
        for roles in itertools.product([*chat.ROLES, None], repeat=n):
            chosen, end = chat.repair(roles, chat.START, chat.END)
            state, cost = chat.START, 0
            for role, (to, between, merged) in zip(roles, chosen):
                cost += min(m[0] for m in chat.MOVES[role] if m[1:] == (state, to, between, merged))
                assert to == state if merged else to in chat.LEGAL[between if between >= 0 else state]
                state = to
            assert state == end and cost + chat.END[end] == cheapest(roles)


def test_chunks_do_not_change_the_result(spark):
    import random

    random.seed(10)
    rows = [(c, t, random.choice(["system", "user", "assistant", " User ", "bot", None]), f"t{c}-{t}") for c in range(20) for t in range(random.randint(1, 40))]
    rows += [(None, None, "user", "x"), (None, 1, "user", None), (None, None, "user", "y"), (5, 3, "user", "dup"), (5, 3, "user", "dup"), (77, 1, None, "")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("chunk", F.lit("x"))

    def rendered(chunk):
        out: dict = {}
        for r in sorted(chat.repaired(turns, chunk=chunk).collect(), key=lambda r: (r.conv_id or "", r.chunk, r.seq)):
            out[r.conv_id] = out.get(r.conv_id, "") + r.rendered
        return out

    whole = rendered(4096)
    assert whole == rendered(3) and len(whole) == 22 and whole["5"].count("dup") == 2
    for text in whole.values():
        roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
        body = roles[1:] if roles[0] == "system" else roles
        assert body == ["user", "assistant"] * (len(body) // 2) and text.endswith("<|im_end|>\n")
    assert chat.repaired(turns.limit(0)).count() == 0


# pipeline --------------------------------------------------------------------
def test_pipeline_stages(spark, docs):
    after = {"": docs}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = common.cut_lineage(stage(spark, at, SF))
        after[name] = at
        assert name == "pack" or at.columns == docs.columns
    kept = {r.doc_id: r.keep for r in kneser_ney.judged(docs, queries.trusted_ids(spark, SF)).collect()}
    assert {r.doc_id for r in after["quality"].collect()} == {i for i, k in kept.items() if k}
    left = [(r.doc_id, r.text) for r in after["quality"].collect()]
    assert {r.doc_id for r in after["near_duplicates"].collect()} == {d for d, _, c in plain_groups(left) if d == c}
    sizes: dict = {}
    for r in after["near_duplicates"].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    got: dict = {}
    for r in after["mix"].collect():
        got[r.source] = got.get(r.source, 0) + len(words(r.text))
        assert r.n_chars == len(r.text)
    for s, want in plain_targets(sizes).items():
        assert abs(got.get(s, 0) - want) <= 3
    ids = plain_ids([r.text for r in after["mix"].collect()], "word_bpe_49k.json")
    assert sum(r.length for r in at.collect()) == sum(map(len, ids))
    whole = {(r.doc_id, r.doc_tokens, r.ids_crc32) for r in at.collect() if r.length == r.doc_tokens}
    assert whole <= {(r.doc_id, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(after["mix"].collect(), ids)}


def test_pipeline_stages_on_odd_tables(spark, odd, none):
    for table in (odd, none.withColumn("draws", F.lit(1))):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            at = common.cut_lineage(stage(spark, at, SF))
            assert name == "pack" or at.columns == table.columns
    near = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, common.cut_lineage(odd), SF).collect()]
    assert sorted(x for x in near if x is not None) == [1, 4, 5, 6, 7, 8, 10, 11, 12, 12, 13] and near.count(None) == 1


def test_every_operator_has_a_query():
    numbers = sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and json.dumps(sorted(queries.ORACLES))


def test_coder_does_few_steps_for_many_blocks(monkeypatch):
    """A frame of many ids is many short blocks: what counts is how often all of them move."""
    steps = []
    predict = range_coder.Model.predict
    monkeypatch.setattr(range_coder.Model, "predict", lambda self, a: steps.append(a) or predict(self, a))
    rng = np.random.default_rng(5)
    ids = np.minimum(50_000, rng.pareto(0.7, 300_000) * 3).astype(np.int64)
    coded = range_coder.encode_blocks(ids, 65_536)
    assert len(steps) <= 1024 and (range_coder.decode_blocks(coded, len(ids), 65_536) == ids).all() and len(steps) <= 2048
    # Any block can be read with nothing but the frequencies.
    assert (range_coder.decode_blocks([coded[0], coded[7]], 1024, 65_536) == ids[6 * 1024:7 * 1024]).all()
    # Order 0 is fitted: not more than a tenth above the entropy.
    times = np.unique(ids, return_counts=True)[1] / len(ids)
    assert 8 * sum(map(len, coded)) / len(ids) < 1.1 * -(times * np.log2(times)).sum()


def test_carries_reach_what_was_written():
    out = range_coder._Writer(2, 40)
    out.words[:3], out.at[0] = (7, 2**32 - 1, 2**32 - 1), 3
    out.low[:], out.range[:] = (2**64 - 5, 9), (2**40, 2**40)
    out.code(2, np.array([3, 0], np.uint64), np.array([1, 1], np.uint64), 2)
    assert out.words[:3].tolist() == [8, 0, 0] and out.words[out.width] == 0


def test_damaged_frequencies_are_noticed():
    ids = np.arange(5000) % 700
    data = token_files.frame(0, 0, np.array([1]), np.array([False]), np.array([5000]), ids, 65_536, 512)
    at = data.index(range_coder.encode_blocks(ids, 65_536, 512)[0])
    with pytest.raises(token_files.DamagedBlock, match="frequencies"):
        token_files.unframe(data[:at + 9] + bytes([data[at + 9] ^ 1]) + data[at + 10:])


@pytest.mark.parametrize("special", [False, True])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_in_one_text_have_their_own_ids(name, special):
    encoder = tokens.Encoder(queries.vocabulary(name), special)
    alone = tokens.Encoder(queries.vocabulary(name), special)
    alone.joined = None
    pieces = [" a", "a<|endoftext|>b", "<|endo", "ftext|>", "", "  ", "\n\n", "e", "́", "'", "s", " ABC1"] * 20
    for some in (pieces, [*pieces, f"x{tokens.BETWEEN}y"], ["one"]):
        for got, want in zip(encoder._ids(some), alone._ids(some), strict=True):
            assert got.tolist() == want.tolist()
    calls = []
    encoder.joined = type("Counted", (), {"encode_batch_fast": lambda _, texts, **how: calls.append(len(texts)) or alone.tokenizer.encode_batch_fast(["x"], **how)})()
    encoder._ids(pieces)
    assert calls == [-(-len(pieces) // tokens.TOGETHER)]


def test_trusted_ids_are_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            reads.add(len(pdf))
            yield pdf

    rows = [(i, f"the cat {i} sat on the mat {i * i}", "en") for i in range(40)] + [(None, "no id", "en"), (50, "other", None), (50, "text", "de")]
    docs = common.cut_lineage(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    ids = spark.createDataFrame([(i,) for i in [*range(30), 3, 50, 999]] + [(None,)], "doc_id bigint").mapInPandas(counted, "doc_id bigint")
    got = kneser_ney.judged(docs, ids).collect()
    assert reads.value == 34
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.lang) for r in got) == sorted((r[0] is not None, r[0] or 0, "de" if r[0] == 50 else r[2]) for r in rows)
    assert all(r.score is not None and r.threshold is not None for r in got)


@pytest.mark.parametrize("many", [1, 30])
def test_a_task_of_the_model_has_one_python_step(spark, many):
    rows = [(1, "ab"), (1, "abc"), (2, "xyz"), (3, None), (None, "abcd")] + [(10 + i, "pq") for i in range(many)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = common.cut_lineage(spark.createDataFrame([(1,), (3,), (77,), (None,)] + [(10 + i,) for i in range(many)], "doc_id bigint"))
    good = kneser_ney.trusted_rows(docs, ids)
    assert sorted((r.doc_id, r.text or "") for r in good.collect()) == sorted((k, t or "") for k, t in rows if k not in (None, 2))
    counts = kneser_ney.gram_counts(good, "text", 2)
    assert {r.gram: r.c for r in counts.collect()} == {"\x02a": 2, "ab": 2, "bc": 1, "\x02p": many, "pq": many}
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" in plan and "BroadcastHashJoin" not in plan
    physical = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    between = physical[physical.index("MapInArrow"):physical.index("ArrowEvalPython")]
    assert " Exchange hashpartitioning" in between


def test_texts_go_to_python_in_small_batches(spark):
    docs = spark.range(3000).coalesce(1).selectExpr("id AS doc_id", "repeat('ab ', 4000) AS text", "'en' AS lang")
    spark.conf.unset(common.MAX_BYTES)
    try:
        packing.packed(docs, queries.vocabulary("word_bpe_49k.json"))
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n bigint, size bigint").collect()
        assert sum(r.n for r in sizes) == 3000 and max(r["size"] for r in sizes) < 2 * common.BATCH_BYTES
        spark.conf.set(common.MAX_BYTES, "1000000")
        common.small_batches(spark)
        assert spark.conf.get(common.MAX_BYTES) == "1000000"
    finally:
        spark.conf.unset(common.MAX_BYTES)


def test_results_do_not_depend_on_batches(spark):
    docs = common.cut_lineage(spark.read.parquet(f"{SF}/documents.parquet").coalesce(1))
    trusted = queries.trusted_ids(spark, SF)
    results = []
    try:
        for most in ("3000", "64000000"):
            spark.conf.set(common.MAX_BYTES, most)
            results.append([sorted(map(repr, rows.collect())) for rows in (
                packing.packed(docs, queries.vocabulary("word_bpe_49k.json"), special=True), jaccard_join.near_groups(docs),
                kneser_ney.judged(docs, trusted).select("doc_id", "n", F.round("log_perplexity", 9), "keep"))])
    finally:
        spark.conf.unset(common.MAX_BYTES)
    assert results[0] == results[1] and all(results[0])


def test_rounds_of_components_shuffle_little(spark):
    from huntspark.llm import components

    edges = common.cut_lineage(spark.createDataFrame([(v + 1, v) for v in range(20)] + [(9, 2), (17, 1)], "u bigint, v bigint"))
    large = components._star(edges, large=True)
    small = components._star(large, large=False)
    assert large.count() <= edges.count() and small.distinct().count() == small.count()
    # The least neighbours and the edges they meet, each dealt once.
    assert large._jdf.queryExecution().sparkPlan().toString().count("Aggregate") == 2
    assert {(r.node, r.least) for r in components.components(edges, "u", "v").collect()} == {(v, 0) for v in range(21)}


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_orders_of_the_model_are_jobs_of_their_own(spark, order):
    train = ["abracadabra", "alakazam abra", "hocus pocus cadabra", "", "été"]
    model = kneser_ney.Model(kneser_ney.gram_counts(spark.createDataFrame([(t,) for t in train], "text string"), "text", order), order)
    grams = sorted({(kneser_ney.START * (order - 1) + t)[j:j + order] for t in ["abra cadabra", "zzz", "hocus", "tété"] for j in range(len(t))})
    known = model.probabilities(common.cut_lineage(spark.createDataFrame([(g,) for g in grams], "gram string")))
    # Rows and tables of one order only.
    assert known._jdf.queryExecution().sparkPlan().toString().count("Join ") <= 3
    p = plain_kneser_ney(train, order)
    got = {r.gram: r.p for r in known.collect()}
    assert sorted(got) == grams and all(got[g] == pytest.approx(p(g), rel=1e-9) for g in grams)
