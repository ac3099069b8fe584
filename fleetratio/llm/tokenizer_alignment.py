"""Alignment of two tokenizers over the same text, and how often their tokens end together.

Both token sequences become arrays of byte ends. While the ends agree at the current shift between the two indexes,
growing slices are compared at once and whole one-to-one stretches are jumped; where they part, the lesser end
advances until both meet again, which closes one irregular group and sets the new shift.

A pair of ids that ends together has the bytes of one as a suffix of the bytes of the other. So the distinct pairs
are at most the bytes of both vocabularies, whatever the corpus: their counts may travel to every task.
"""

from __future__ import annotations

import json
import os
import re
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetratio.llm.common import stored, text_of

#: Characters of text that are encoded in one go.
CHUNK = 1 << 18
#: Fixed value: the pattern by which byte-level vocabularies of this kind cut text before merging.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that all regex engines class alike, and runs that none of them finds too long.
COMMON, LONGEST_RUN = re.compile(r"[\x00-\u052F\u2010-\u2027\u20AC]*"), 5_000


class Vocabularies(NamedTuple):
    """Contents of the two files, as they travel to the tasks: a byte-level BPE and a sentence piece model."""

    a_json: str
    b_model: bytes


def read_vocabularies(a_path: str, b_path: str) -> Vocabularies:
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return Vocabularies(a.read(), b.read())


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 as itself and the other bytes as 256, 257, …"""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def rank_encoder(a_json: str, a_bytes: list[bytes]):
    """A faster encoder with the same result, where the vocabulary is plain byte-level BPE with ids in the order of
    its merges; None for any other."""
    import tiktoken

    a = json.loads(a_json)
    cut, merges = a["pre_tokenizer"] or {}, a["model"].get("merges", [])
    plain = a["normalizer"] is None and all(t["special"] for t in a["added_tokens"])
    plain = plain and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut["add_prefix_space"]
    ids = a["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if not plain or [ids["".join(m)] for m in pairs] != list(range(256, 256 + len(pairs))):
        return None
    return tiktoken.Encoding("a", pat_str=CUT, mergeable_ranks={a_bytes[i]: i for i in ids.values() if i < 256 + len(pairs)}, special_tokens={})


class Encoders:
    """Both tokenizers with the bytes of each of their tokens."""

    def __init__(self, vocabularies: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabularies.a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b_model)
        table = byte_of_character()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = [bytes(table[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.ranks = rank_encoder(vocabularies.a_json, self.a_bytes)

    def by_ranks(self, text: str) -> bool:
        return self.ranks is not None and COMMON.fullmatch(text) is not None and (len(text) < LONGEST_RUN or not re.search(rf"\S{{{LONGEST_RUN}}}|\s{{{LONGEST_RUN}}}", text))

    def encode_a(self, text: str) -> list[int]:
        return self.ranks.encode_ordinary(text) if self.by_ranks(text) else self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none where either does not give back the bytes of space and text."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            raw, a = f" {text}".encode(), self.encode_a(f" {text}")
            same = b"".join(map(self.b_bytes.__getitem__, b)) == raw and b"".join(map(self.a_bytes.__getitem__, a)) == raw
            out.append(tuple(np.array(ids if same else [], np.int32) for ids in (a, b)))
        return out


def aligned_groups(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Tokens of either side in each group, from the ends of both; the last ends must be equal."""
    i, j, n = 0, 0, len(a)
    left, right = [], []
    while i < n:
        step, start = 1, i
        while i + step <= n and a[i : i + step] == b[j : j + step]:  # doubles while the diagonal holds
            i, j, step = i + step, j + step, 2 * step
        while step > 1:  # and narrows down to where it breaks
            step //= 2
            if i + step <= n and a[i : i + step] == b[j : j + step]:
                i, j = i + step, j + step
        if i > start:
            ones = [1] * (i - start)
            left += ones
            right += ones
        if i < n:
            p, q = i, j
            while a[p] != b[q]:
                if a[p] < b[q]:
                    p += 1
                else:
                    q += 1
            left.append(p + 1 - i)
            right.append(q + 1 - j)
            i, j = p + 1, q + 1
    return left, right


def _lists(rows: list) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([NO_IDS, *(np.array(r, np.int32) for r in rows)])))


def _decoded(raw: bytes) -> str:
    """The text; empty if its bytes are no UTF-8, as no token could give them back."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return ""


NO_IDS = np.zeros(0, np.int32)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"), F.xxhash64(text_of()).alias("text_hash"))


def _coded(batches, coders: Encoders):
    """(some rows of a batch, ids of A and B of each, group sizes of A and B of each), few texts at a time."""
    for batch in batches:
        texts, at = batch["text"], 0
        while at < len(texts):
            chunk, size = [], 0
            while at + len(chunk) < len(texts) and (not chunk or size < CHUNK):
                chunk.append(_decoded(texts[at + len(chunk)].as_py()))
                size += len(chunk[-1])
            ids = iter(coders.encode([t for t in chunk if t]))
            coded = [next(ids) if t else (NO_IDS, NO_IDS) for t in chunk]
            ends = ((np.cumsum(coders.a_length[a]).tolist(), np.cumsum(coders.b_length[b]).tolist()) for a, b in coded)
            yield batch.slice(at, len(chunk)), coded, [aligned_groups(a, b) for a, b in ends]
            at += len(chunk)


def align(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """(doc_id, text_hash, a_ids, b_ids, a_sizes, b_sizes): ids of both tokenizers for each text, and how many
    tokens of either side each group holds.

    Texts that are null or empty, or that one of the tokenizers does not give back byte by byte, have empty arrays.
    Repeated rows and null ids keep one row each, an empty table gives an empty result; only ``doc_id`` and
    ``text`` are read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def run(batches):
        for rows, coded, sizes in _coded(batches, Encoders(shipped.value)):
            lists = [_lists([r[k] for r in side]) for side in (coded, sizes) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["text_hash"], *lists], ["doc_id", "text_hash", "a_ids", "b_ids", "a_sizes", "b_sizes"])

    return _keyed(docs).mapInArrow(run, "doc_id long, text_hash long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>")


def shown_ids(size: int) -> np.ndarray:
    """Each id below ``size`` in digits, followed by a comma, a bar or a semicolon."""
    return np.array([f"{i}{mark}".encode() for i in range(size) for mark in ",|;"], object)


def groups_text(a_ids: np.ndarray, b_ids: np.ndarray, a_sizes: list[int], b_sizes: list[int], shown: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group in order. All pieces are placed at once: a token of A comes after
    the B tokens of the groups before its own, one of B after the A tokens of its own as well."""
    x, y = np.array(a_sizes, np.int64), np.array(b_sizes, np.int64)
    a_ends, b_ends = np.cumsum(x), np.cumsum(y)
    a, b = 3 * a_ids.astype(np.int64), 3 * b_ids.astype(np.int64)
    a[a_ends - 1] += 1
    b[b_ends - 1] += 2
    pieces = np.empty(len(a) + len(b), np.int64)
    pieces[np.arange(len(a)) + np.repeat(b_ends - y, x)] = a
    pieces[np.arange(len(b)) + np.repeat(a_ends, y)] = b
    return b"".join(shown[pieces].tolist())[:-1]


def linked_pairs(a_ids: np.ndarray, b_ids: np.ndarray, a_sizes: list[int], b_sizes: list[int]) -> np.ndarray:
    """Pairs of ids that end together, A above 32 bits of B. Every token has a byte at least, so one token of either
    side ends at the end of a group: its last one."""
    a, b = (ids[np.cumsum(np.array(sizes, np.int64)) - 1].astype(np.int64) for ids, sizes in ((a_ids, a_sizes), (b_ids, b_sizes)))
    return (a << 32) | b


def alignment_links(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """(doc_id, text_hash, n_a, n_b, n_groups, groups_sha256, links): ``align`` in short, for counting. ``links`` are
    the linked pairs of ids, packed as bytes."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def run(batches):
        coders = Encoders(shipped.value)
        shown = shown_ids(max(len(coders.a_bytes), len(coders.b_bytes)))
        for rows, coded, sizes in _coded(batches, coders):
            full = [(*c, *s) for c, s in zip(coded, sizes)]
            columns = {
                "doc_id": rows["doc_id"],
                "text_hash": rows["text_hash"],
                "n_a": pa.array([len(f[0]) for f in full], pa.int64()),
                "n_b": pa.array([len(f[1]) for f in full], pa.int64()),
                "n_groups": pa.array([len(f[2]) for f in full], pa.int64()),
                "groups_sha256": pa.array([sha256(groups_text(*f, shown)).hexdigest() if len(f[0]) else "" for f in full], pa.string()),
                "links": pa.array([linked_pairs(*f).tobytes() for f in full], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return _keyed(docs).mapInArrow(run, "doc_id long, text_hash long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def link_counts(linked: DataFrame) -> DataFrame:
    """(a_id, b_id, n): how many links of the corpus hold each pair of ids; summed in each task before the shuffle."""

    def run(batches):
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found, n = np.unique(np.frombuffer(b"".join(batch["links"][at : at + 500].to_pylist()), np.int64), return_counts=True)
                pairs, back = np.unique(np.concatenate([pairs, found]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    summed = linked.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return summed.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b_id"), "n")


def alignment_report(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``alignment_links``.

    ``n_best`` are the links whose pair no other pair of the same b id outnumbers, ``count_sum`` adds the corpus counts
    of the links. ``counts`` is that of ``link_counts``: at most as many rows as the vocabularies have bytes, so it is
    sent to the tasks as it is.
    """
    table = counts.select((F.shiftleft(F.col("a_id").cast("long"), 32) + F.col("b_id")).alias("pair"), "n").toArrow()
    pairs, n = table["pair"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    b_ids = pairs & 0xFFFFFFFF
    top = np.zeros(int(b_ids.max(initial=0)) + 1, np.int64)
    np.maximum.at(top, b_ids, n)
    shipped = linked.sparkSession.sparkContext.broadcast((pairs, n, n == top[b_ids]))

    def run(batches):
        pairs, n, best = shipped.value
        for batch in batches:
            rows = []
            for links in batch["links"]:
                at = np.searchsorted(pairs, np.frombuffer(links.as_buffer(), np.int64))
                rows.append((len(at), int(best[at].sum()), int(n[at].sum())))
            named = {name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(("n_links", "n_best", "count_sum"))}
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("doc_id", "n_a", "n_b", "n_groups")} | named | {"groups_sha256": batch["groups_sha256"]})

    return linked.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignment_statistics(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """``alignment_report`` of the documents over the counts of their own corpus; texts are encoded once."""
    linked = stored(alignment_links(docs, vocabularies), "linked")
    return alignment_report(linked, link_counts(linked))
