"""Alignment of two tokenizations of the same texts, on Arrow columns.

A slice of texts becomes two list columns of ids. Flattened, with the parent
index of every id, they turn into byte ends by a cumulative sum that begins
anew in every document. A hash join on (document, end) gives the links: tokens
of both sides that end at the same byte. Links cut a document into groups.

How often a pair of ids is linked is counted per block of texts with
``group_by``; the partial counts are merged by Spark, and a block gets back the
counts of the pairs it holds. The links of a document are kept as numbers into
its block's list of pairs, so a link moves as four bytes.
"""
from __future__ import annotations

import hashlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import tokens
from .common import cut_lineage

#: Bytes of text that are aligned at once, and that make a block of partial counts.
SLICE, BLOCK = 500_000, 8_000_000
#: Pieces that a worker remembers per vocabulary.
REMEMBER = 250_000
#: Pairs and ends are one 64-bit key each: first id or document above these bits.
_PAIR, _END = 32, 38
_DOCS = 1 << (63 - _END)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the others for the
    characters from 256 upwards, in order.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces:
    """A sentencepiece model behind the one call that the encoder makes; texts come with the blank the model would add."""

    def __init__(self, model):
        self.model, self.blank = model, model.piece_to_id("▁")

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False):
        # A lone blank has nothing behind the model's own one, and nothing would be encoded.
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [SimpleNamespace(ids=ids if t != " " else [self.blank]) for t, ids in zip(texts, found)]


class PieceEncoder(tokens.Encoder):
    """Ids of a sentencepiece model, each distinct piece of text encoded once.

    No entry holds the mark of a blank behind another character, so a text may
    be cut before every blank that follows something else. Texts begin with the
    blank the model would add in front. (Next to a U+2581 of the text itself a
    cut may be wrong; such a text differs from its entries' bytes anyway.)
    """

    def __init__(self, model):
        if any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size())):
            raise ValueError("an entry spans a word's beginning; texts cannot be cut there")
        self.tokenizer, self.special = _Pieces(model), None
        self._forget()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        marks = np.zeros(len(data), bool)
        marks[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        marks[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(marks)
        place = self._places(data, starts, np.diff(np.append(starts, len(data))))
        count = self.count[place]
        ids = self.ids[tokens.spans(self.first[place], count)]
        before = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        return ids, np.diff(before[np.searchsorted(starts, offsets)])


class Vocabulary:
    """An encoder and the bytes of its entries."""

    def __init__(self, encoder: tokens.Encoder, entries: list[bytes]):
        encoder.remember = REMEMBER
        self.encoder, self.bytes = encoder, pa.array(entries, pa.large_binary())
        self.sizes = pc.binary_length(self.bytes).cast(pa.int64())

    def tokens(self, texts: pa.Array) -> pa.LargeListArray:
        """Ids of every text; a text that its entries do not spell has none."""
        data, offsets = tokens.buffers(texts)
        ids, count = self.encoder.encode(data, offsets)
        spelt = pc.take(self.bytes, pa.array(ids))
        spelt = pa.LargeStringArray.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.zeros(2, np.int64)), None]) if not len(ids) else spelt
        at = np.append(0, np.cumsum(count))
        ends = np.append(0, np.cumsum(pc.take(self.sizes, pa.array(ids)).to_numpy()))[at]
        out = np.frombuffer(spelt.buffers()[2], np.uint8)[:ends[-1]] if ends[-1] else np.empty(0, np.uint8)
        if len(out) != len(data) or (ends != offsets).any() or (out != data).any():
            fine = [out[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(ends, ends[1:], offsets, offsets[1:])]
            ids, count = ids[np.repeat(fine, count)], np.where(fine, count, 0)
        return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(count))), pa.array(ids.astype(np.int64)))


def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary of the tokenizers library; strings of special tokens are plain text."""
    encoder, alphabet = tokens.Encoder(path), byte_alphabet()
    entries = [b""] * (1 + max(encoder.tokenizer.get_vocab().values()))
    for entry, i in encoder.tokenizer.get_vocab().items():
        entries[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
    return Vocabulary(encoder, entries)


def piece_level(path: str) -> Vocabulary:
    """A sentencepiece vocabulary with byte fallback."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    entries = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
    return Vocabulary(PieceEncoder(model), entries)


_PAIRS: dict[tuple[str, str], tuple[Vocabulary, Vocabulary]] = {}


def vocabularies(a: str, b: str) -> tuple[Vocabulary, Vocabulary]:
    """Both, once per worker."""
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = byte_level(a), piece_level(b)
    return _PAIRS[a, b]


def ends(lists: pa.LargeListArray, sizes: pa.Array) -> pa.Table:
    """``key, id, at``: for every token its document and byte end as one key, its id, and its number among all."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    upto = pc.cumulative_sum(pc.take(sizes, ids))
    # The sum begins anew in each document: what was summed before its first token is taken off.
    before = pa.concat_arrays([pa.array([0], pa.int64()), upto])
    base = pc.take(pc.take(before, lists.offsets.slice(0, len(lists))), doc)
    key = pc.add(pc.shift_left(doc, _END), pc.subtract(upto, base))
    return pa.table({"key": key, "id": ids, "at": np.arange(len(ids))})


def joined(strings: pa.Array, offsets: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), strings), pa.scalar(by, pa.large_string()))


def aligned(texts: pa.Array, a: Vocabulary, b: Vocabulary) -> tuple[pa.Table, pa.Array]:
    """``n_a, n_b, n_groups, groups`` of every text, and the linked pairs of all texts in order, as ``a << 32 | b``."""
    blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), none)
    asked = pc.if_else(pc.equal(pc.binary_length(texts), 0), none, pc.binary_join_element_wise(blank, texts, none))
    lists = [v.tokens(asked) for v in (a, b)]
    # Both sides must spell the text.
    both = pc.and_(*[pc.greater(pc.list_value_length(x), 0) for x in lists])
    lists = [pc.if_else(both, x, pa.scalar([], x.type)) if not pc.all(both).as_py() else x for x in lists]
    left, right = (ends(x, v.sizes) for x, v in zip(lists, (a, b)))
    links = left.join(right, "key", join_type="inner", right_suffix="_b", use_threads=False).sort_by("key").combine_chunks()
    column = lambda name: links.column(name).to_numpy()
    pairs = pc.bit_wise_or(pc.shift_left(links.column("id"), _PAIR), links.column("id_b"))
    doc = column("key") >> _END
    sides = [joined(pc.cast(pc.list_flatten(x), pa.large_string()), np.append(0, column(at) + 1), ",") for x, at in zip(lists, ("at", "at_b"))]
    groups = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
    n = np.bincount(doc, minlength=len(texts))
    whole = joined(groups, np.append(0, np.cumsum(n)), ";")
    return pa.table({"n_a": pc.list_value_length(lists[0]), "n_b": pc.list_value_length(lists[1]), "n_groups": n, "groups": whole}), pairs


def partial_counts(pairs: pa.ChunkedArray) -> tuple[pa.Table, np.ndarray]:
    """``pair, n`` of a block, and for every link the row of its pair."""
    coded = pairs.combine_chunks().dictionary_encode() if len(pairs) else pa.array([], pa.int64()).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    counts = pa.table({"slot": coded.indices}).group_by("slot", use_threads=False).aggregate([([], "count_all")]).sort_by("slot")
    return pa.table({"pair": coded.dictionary, "n": counts.column("count_all")}), coded.indices.to_numpy()


SCHEMA = ("block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary, slot int, pair bigint, n bigint")


def _blocks(a: str, b: str, slice_bytes: int, block_bytes: int):
    """Rows of documents and, behind those of a block, one row per pair that the block links."""

    def table(rows: int, **columns) -> pa.RecordBatch:
        kinds = {"groups_sha256": pa.string(), "links": pa.binary(), "slot": pa.int32()}
        full = {c.split()[0]: columns.get(c.split()[0]) for c in SCHEMA.split(", ")}
        return pa.RecordBatch.from_arrays([pa.nulls(rows, kinds.get(k, pa.int64())) if v is None else pa.array(v, kinds.get(k, pa.int64())) for k, v in full.items()], names=list(full))

    def run(batches):
        first, second = vocabularies(a, b)
        block, room, held = TaskContext.get().partitionId() << 32, block_bytes, []

        def flush():
            counts, slots = partial_counts(pa.chunked_array([p for _, _, p in held], pa.int64()))
            slots, at = slots.astype("<i4"), 0
            for keys, rows, _ in held:
                n = rows.column("n_groups").to_numpy()
                ends = at + np.cumsum(n)
                raw = [slots[e - k:e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                at = int(ends[-1])
                yield table(len(keys), block=np.full(len(keys), block), doc_id=keys, n_a=rows.column("n_a").to_numpy(), n_b=rows.column("n_b").to_numpy(), n_groups=n,
                            groups_sha256=rows.column("sha").to_pylist(), links=raw)
            for p in range(0, len(counts), 100_000):
                part = counts.slice(p, 100_000)
                yield table(len(part), block=np.full(len(part), block), slot=np.arange(p, p + len(part)), pair=part.column("pair").to_numpy(), n=part.column("n").to_numpy())

        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1).cast(pa.large_string()), 0
            offsets = tokens.buffers(texts)[1]
            while at < len(keys):
                end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + slice_bytes, side="right")) - 1), at + _DOCS - 1, len(keys))
                rows, pairs = aligned(texts.slice(at, end - at), first, second)
                sha = [hashlib.sha256(g.as_buffer()).hexdigest() if len(g.as_buffer()) else "" for g in rows.column("groups").combine_chunks().cast(pa.large_binary())]
                rows = rows.drop_columns("groups").append_column("sha", pa.array(sha, pa.string()))
                held.append((keys.slice(at, end - at), rows, pairs.combine_chunks() if isinstance(pairs, pa.ChunkedArray) else pairs))
                room, at = room - int(offsets[end] - offsets[at]), end
                if room <= 0:
                    yield from flush()
                    block, room, held = block + 1, block_bytes, []
        if held:
            yield from flush()

    return run


def _answer(docs, pairs):
    """Sums over the links of every document of a block, from the counts of the block's pairs."""
    pairs = pairs.sort_by("slot")
    links = np.frombuffer(b"".join(docs.column("links").to_pylist()), "<i4")
    at = np.append(0, np.cumsum(docs.column("n_groups").to_numpy()))

    def sums(name: str) -> np.ndarray:
        each = pc.take(pairs.column(name).combine_chunks().cast(pa.int64()), pa.array(links)) if len(links) else pa.array([], pa.int64())
        return np.diff(np.append(0, pc.cumulative_sum(each).to_numpy())[at])

    out = docs.select(["doc_id", "n_a", "n_b", "n_groups"])
    for name, values in (("n_links", docs.column("n_groups")), ("n_best", sums("best")), ("count_sum", sums("total")), ("groups_sha256", docs.column("groups_sha256"))):
        out = out.append_column(name, values if isinstance(values, pa.ChunkedArray) else pa.array(values))
    return out


def tallied(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", slice_bytes: int = SLICE, block_bytes: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents and pairs of all blocks as written tables: what ``linked`` and ``pair_counts`` go on from."""
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = cut_lineage(rows.mapInArrow(_blocks(a, b, slice_bytes, block_bytes), SCHEMA))
    return found.filter("pair IS NULL").drop("slot", "pair", "n"), found.filter("pair IS NOT NULL").select("block", "slot", "pair", "n")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pair, total, best``: links of every pair of ids in all texts, and whether no other pair of its second id has more."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("second", F.col("pair").bitwiseAND(F.lit((1 << _PAIR) - 1)))
    totals = cut_lineage(totals)
    most = totals.groupBy("second").agg(F.max("total").alias("most"))
    return totals.join(most, "second").select("pair", "total", (F.col("total") == F.col("most")).cast("int").alias("best"))


def linked(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", slice_bytes: int = SLICE, block_bytes: int = BLOCK) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: one row per row of ``docs``.

    ``a`` is the file of a byte-level vocabulary (given a blank and the text),
    ``b`` that of a sentencepiece model. A text that is NULL or empty, or that
    the entries of either side do not spell, has no tokens: zeros and ''. No
    entry that a text can give is empty, so every group ends with one link.
    ``n_best`` counts links whose pair no other pair of the same second id
    exceeds, ``count_sum`` adds up the pairs' counts. Repeated ids and rows are
    aligned and counted like any others; other columns are left out.
    """
    rows, pairs = tallied(docs, a, b, key, text, slice_bytes, block_bytes)
    answers = pairs.select("block", "slot", "pair").join(pair_counts(pairs), "pair").select(F.col("block").alias("asker"), "slot", "total", "best")
    return rows.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(
        _answer, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
