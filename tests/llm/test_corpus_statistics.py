"""Importance resampling, tokenizer alignment and one-permutation MinHash against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetratio.llm import oneperm_minhash as minhash
from fleetratio.llm import tokenizer_alignment as alignment
from fleetratio.llm.importance_resampling import bucket_counts, gram_pattern, importance_draw, resample
from fleetratio.llm.queries import A_VOCABULARY, B_VOCABULARY

SPACE = re.compile("[^\x20\x09-\x0d]+")
RUNS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", " ", "Ünïcödé 𝄞 text", "tabs\tand\nlines \n\n  two  spaces ", "<|endoftext|> <s> </s> <0x41>", "▁piece▁", "a\x00b\x1c c\x85d", "x" * 300, "1,000.5 it's DON'T", " lead", "trail   "]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ka", "Lo", "mi", "ten", "ra", "ü", "vel", "or", "9"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng, rows = random.Random(5), [prose(i, 3 + 4 * i) for i in range(40)]
    for i in range(60):
        words = rows[10 + i % 25].split(" ")
        for _ in range(1 + i % 4):
            words[rng.randrange(len(words))] = rng.choice(["changed", "edit", "word"])
        rows.append(" ".join(words))
    return [*rows, *rows[:5], rows[12].upper(), *ODD, None]


# ---- importance resampling


def words_of(text):
    return RUNS.findall((text or "").translate(UPPER))


def grams_of(text, n):
    words = words_of(text)
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_overlapped_spans_are_all_runs_of_words(texts, n):
    patterns = [gram_pattern(k) for k in range(1, n + 1)]
    for text in filter(None, texts):
        n_words, found = bucket_counts(text.encode(), patterns, 977)
        assert n_words == len(words_of(text))
        assert dict(found) == Counter(crc32(g.encode()) % 977 for g in grams_of(text, n))


def brute_scores(rows, target, n, buckets):
    corpus, wanted = (Counter(crc32(g.encode()) % buckets for t in ts for g in grams_of(t, n)) for ts in ([r[1] for r in rows], target))
    s_all, t_all, out = corpus.total(), wanted.total(), []
    for i, text, *_ in rows:
        grams = grams_of(text, n)
        weight = 0
        for g in grams:
            b = crc32(g.encode()) % buckets
            weight += math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets))))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    able = sorted((-r[3], r[0] is None, r[0] or 0) for r in out if r[4] >= 20)
    return out, able


@pytest.mark.parametrize("n", [1, 2])
def test_draw_against_brute_force(spark, make_docs, texts, n):
    rows, target = list(enumerate(texts)), [prose(12, 40), prose(3, 30), None, ""]
    scores, able = brute_scores(rows, target, n, 500)
    bench = spark.createDataFrame([(str(k), t) for k, t in enumerate(target)], "item_id string, text string")
    got = importance_draw(make_docs(rows), bench, percent=25, max_n=n, buckets=500).collect()
    assert {(r.doc_id, r.n_features, r.weight, r.score) for r in got} == {s[:4] for s in scores}
    ranks = {i: k + 1 for k, (_, _, i) in enumerate(able[: 25 * len(able) // 100])}
    assert len(ranks) > 10 and {r.doc_id: r["rank"] for r in got if r["rank"]} == ranks


def test_draw_of_awkward_rows(awkward, awkward_rows, nothing):
    got = importance_draw(awkward, awkward.limit(3), percent=50).collect()
    assert len(got) == len(awkward_rows)
    want, _ = brute_scores(awkward_rows, [], 1, 10_000)
    assert sorted((r.n_features, str(r.doc_id)) for r in got) == sorted((w[1], str(w[0])) for w in want)
    able = sum(r.n_words >= 20 for r in got)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, able // 2 + 1))
    assert importance_draw(nothing, awkward).count() == 0
    assert {r.weight for r in importance_draw(awkward, nothing).filter("n_features = 0").collect()} == {0}
    drawn = resample(awkward, nothing, percent=50)
    assert drawn.columns == awkward.columns and 0 < drawn.count() < awkward.count()
    # equal rows come together or not at all
    assert drawn.filter("doc_id = 10").count() in (0, 2)


# ---- tokenizer alignment


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.read_vocabularies(A_VOCABULARY, B_VOCABULARY)


def brute_groups(a, b):
    """Groups between the offsets at which both sides end, by sets of offsets."""
    ends = [{sum(x[: k + 1]) for k in range(len(x))} for x in (a, b)]
    common, out = sorted(ends[0] & ends[1]), ([], [])
    for side, lengths in enumerate((a, b)):
        at, k = 0, 0
        for cut in common:
            n = 0
            while at < cut:
                at, k, n = at + lengths[k], k + 1, n + 1
            out[side].append(n)
    return out


def test_diagonal_runs_against_sets_of_offsets():
    rng = random.Random(2)
    for trial in range(300):
        total = rng.choice([1, 5, 40, 200])
        sides = []
        common = sorted(rng.sample(range(1, total), rng.randint(0, total - 1))) if total > 1 else []
        for _ in range(2):
            own = set(rng.sample(range(1, total), rng.randint(0, min(3, total - 1)))) if total > 1 else set()
            cuts = sorted({*common, *own, total})
            sides.append([y - x for x, y in zip([0, *cuts], cuts)])
        got = alignment.aligned_groups(*(np.cumsum(s).tolist() for s in sides))
        assert got == brute_groups(*sides), trial


def brute_report(rows, vocabularies):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(vocabularies.a_json)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b_model)
    table = alignment.byte_of_character()
    coded, pairs = [], Counter()
    for i, text in rows:
        x = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        p = [bytes(table[c] for c in a.id_to_token(t)) for t in x]
        q = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in y]
        if not (text and b"".join(p) == b"".join(q) == f" {text}".encode()):
            x = y = p = q = []
        ends = [[sum(map(len, side[: k + 1])) for k in range(len(side))] for side in (p, q)]
        links = [(s, t) for s, e in zip(x, ends[0]) for t, f in zip(y, ends[1]) if e == f]
        pairs.update(links)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [[[t for t, e in zip(ids, side) if low < e <= cut] for ids, side in ((x, ends[0]), (y, ends[1]))] for low, cut in zip([0, *cuts], cuts)]
        shown = ";".join(f"{','.join(map(str, s))}|{','.join(map(str, t))}" for s, t in groups)
        coded.append((i, len(x), len(y), len(groups), links, hashlib.sha256(shown.encode()).hexdigest() if x else ""))
    best = Counter()
    for (s, t), n in pairs.items():
        best[t] = max(best[t], n)
    return [(i, x, y, g, len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), d) for i, x, y, g, links, d in coded]


def test_alignment_against_brute_force(make_docs, texts, vocabularies):
    rows = list(enumerate(texts))
    got = alignment.alignment_statistics(make_docs(rows), vocabularies).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_report(rows, vocabularies)
    assert sum(r.n_links > 0 for r in got) > 90 and sum(r.n_a == 0 for r in got) >= 2


def test_aligned_tokens_spell_the_text(make_docs, texts, vocabularies):
    coders = alignment.Encoders(vocabularies)
    for r in alignment.align(make_docs(list(enumerate(texts))), vocabularies).collect():
        assert (sum(r.a_sizes), sum(r.b_sizes)) == (len(r.a_ids), len(r.b_ids)) and len(r.a_sizes) == len(r.b_sizes)
        i = j = 0
        for x, y in zip(r.a_sizes, r.b_sizes):
            assert b"".join(coders.a_bytes[t] for t in r.a_ids[i : i + x]) == b"".join(coders.b_bytes[t] for t in r.b_ids[j : j + y])
            i, j = i + x, j + y


def test_rank_encoder_equals_the_vocabulary_file(vocabularies):
    coders, rng = alignment.Encoders(vocabularies), random.Random(8)
    parts = [*" \n\t\r\x0b\x0c\x1c\x85\xa0ab1.,'éßжΩ²½ªº-", "<|endoftext|>", "  ", "don't", "'LL", "\xad", "‐", "€"]
    tried = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)] + [f"a{chr(k)}1 {chr(k)}{chr(k)} .{chr(k)}." for k in range(1, 0x530)]
    assert sum(map(coders.by_ranks, tried)) > 4000
    assert all(coders.encode_a(t) == coders.a.encode(t, add_special_tokens=False).ids for t in tried)
    assert not coders.by_ranks("漢字") and not coders.by_ranks("x" * 6000)
    assert coders.encode_a("x" * 6000) == coders.a.encode("x" * 6000, add_special_tokens=False).ids


def test_pairs_are_no_more_than_the_bytes_of_the_vocabularies(make_docs, texts, vocabularies):
    """One of two tokens that end together is a suffix of the other, which bounds the table that is sent out."""
    coders = alignment.Encoders(vocabularies)
    counts = alignment.link_counts(alignment.alignment_links(make_docs(list(enumerate(texts))), vocabularies)).collect()
    for r in counts:
        a, b = coders.a_bytes[r.a_id], coders.b_bytes[r.b_id]
        assert a.endswith(b) or b.endswith(a)


def test_alignment_of_awkward_rows(awkward, awkward_rows, nothing, vocabularies):
    got = alignment.alignment_statistics(awkward, vocabularies).collect()
    assert len(got) == len(awkward_rows)
    assert all((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (0, 0, 0, 0, 0, 0, "") for r in got if r.doc_id in (4, 5))
    assert alignment.alignment_statistics(nothing, vocabularies).count() == 0


# ---- one-permutation MinHash


def set_of(text, n=2):
    words = SPACE.findall((text or "").translate(UPPER))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute_components(rows, percent=80):
    sets, label = [set_of(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            label[find(a)] = find(b)
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(k)
    out = []
    for group in members.values():
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        out += [(rows[k][0], len(sets[k]), min(ids, default=None)) for k in group]
    return sorted(out, key=str)


def found_components(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicate_sets(docs).collect()), key=str)


def test_components_against_all_pairs(make_docs, texts):
    rows = list(enumerate(texts))
    want = brute_components(rows)
    assert len({c for _, _, c in want}) < len(rows) - 20
    assert found_components(make_docs(rows)) == want


def family(seed, n, edits):
    """Texts around one original, of which many are alike only by way of others."""
    rng, base = random.Random(seed), prose(seed, 60).split(" ")
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_links_that_a_star_misses_are_found(make_docs, monkeypatch):
    rows = list(enumerate(t for s in range(4) for t in family(s, 40, 7)))
    want = brute_components(rows)
    monkeypatch.setattr(minhash, "TILE", 8)
    monkeypatch.setattr(minhash, "STAR", 5)
    assert found_components(make_docs(rows)) == want
    few = minhash.similar_sets

    def narrow(classes, docs, shingle, percent):
        return few(classes, docs, shingle, percent, most=1)

    monkeypatch.setattr(minhash, "similar_sets", narrow)
    assert found_components(make_docs(rows)) == want


def test_signatures_estimate_similarity():
    """Densified bins of small sets agree as often as the sets are alike."""
    rng, donors = np.random.default_rng(1), minhash.donor_table()
    for size in (1, 3, 10, 60, 2000):
        agree, truth = [], []
        for _ in range(60):
            shared = rng.integers(0, 2**64, size, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**64, max(1, size // 5), dtype=np.uint64)])) for _ in range(2))
            agree.append((minhash.signature(a, donors) == minhash.signature(b, donors)).mean())
            truth.append(size / (size + 2 * max(1, size // 5)))
        assert np.mean(agree) == pytest.approx(np.mean(truth), abs=0.08)


def test_parity_bounds_the_difference_from_below():
    rng = np.random.default_rng(2)
    for size in (1, 50, 5000):
        a = rng.integers(0, 2**64, size, dtype=np.uint64)
        b = np.concatenate([a[: size // 2], rng.integers(0, 2**64, size // 3, dtype=np.uint64)])
        apart = np.bitwise_count(minhash.parity_sketch(a) ^ minhash.parity_sketch(b)).sum()
        assert apart <= len(np.setxor1d(a, b))
        assert np.array_equal(minhash.parity_sketch(a), minhash.parity_sketch(a[::-1].copy()))


def test_bands_find_pairs_at_the_threshold():
    """At a similarity of just 0.8 all of 4,000 pairs share a bucket."""
    rng, donors, missed = np.random.default_rng(3), minhash.donor_table(), 0
    signed = []
    for _ in range(4000):
        shared, left, right = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (80, 10, 10))
        signed.append([minhash.signature(np.unique(np.concatenate([shared, x])), donors) for x in (left, right)])
    keys = minhash.band_keys(np.array(signed).reshape(-1, minhash.BINS), minhash.BANDS, minhash.ROWS).reshape(4000, 2, -1)
    missed = (~(keys[:, 0] == keys[:, 1]).any(axis=1)).sum()
    assert missed <= 3


def test_minhash_of_awkward_rows(awkward, awkward_rows, nothing):
    got = minhash.near_duplicate_sets(awkward)
    assert got.count() == len(awkward_rows) and minhash.near_duplicate_sets(nothing).count() == 0
    assert found_components(awkward) == brute_components(awkward_rows)
    assert got.filter(F.col("doc_id").isin(4, 5, 6)).filter("component_id = doc_id AND n_shingles = 0").count() == 3
