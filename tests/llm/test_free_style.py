"""Operators with Python inside tasks, against brute force."""

import base64
import hashlib
import html
import itertools
import pickle
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.core.broadcast import Broadcast

import corpus_pipeline
from fleetratio.llm import fuzzy_lines
from fleetratio.llm.components import connected_components
from fleetratio.llm.fuzzy_lines import drop_duplicate_lines, line_report, shingles, similar
from fleetratio.llm.qgram_decontamination import EDITS, Q, STEP, WINDOW, banded_edits, contaminated, drop_contaminated, folded, search, window_index
from fleetratio.llm.sentence_spans import drop_repeated_sentences, repeated_sentences, sentence_pieces
from fleetratio.llm.simhash_pivots import fingerprint, fingerprint_links, keep_one_each, near_duplicates
from fleetratio.llm.suffix_two_stage import remove_repeated_strings, two_stage_ranks
from fleetratio.llm.warc_derivatives import BLOCKS, derive_records, digest, metadata_fields, plain_text, record_bytes

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"
LAST = 2**63 - 1


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ten", "ra", "su", "vel", "or"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    out = []
    while len(out) < n:
        sentence = [rng.choice(words) for _ in range(rng.randint(4, 14))]
        out += [*sentence[:-1], sentence[-1] + rng.choice([".", ".", ".\n"])]
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact copies, edited copies, shared passages and repetition inside."""
    rng, rows = random.Random(3), []
    passage = prose(99, 60)
    for i in range(40):
        rows.append((i, prose(i, 30 + 5 * i)))
    for i in range(40, 60):
        words = rows[i - 30][1].split(" ")
        for _ in range(1 + i % 3):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(60, rows[5][1]), (61, rows[5][1]), (62, prose(62, 20) + " " + passage + " " + prose(63, 20)), (63, prose(64, 30) + " " + passage), (64, passage + " " + passage)]
    rows += [(65, "abcab" * 60), (66, "z" * 300), (67, "z" * 120 + "y" + "z" * 49), (68, ""), (69, None)]
    return rows


# ---- pages and benchmark passages that repeat one thing


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<html ", "<script ", "<meta charset", "</", "<!", "<a href='", "x <b y"])
def test_unended_tags_take_time_in_proportion(piece):
    start = time.monotonic()
    for text in (piece * (1_000_000 // len(piece)), piece * (200_000 // len(piece)) + ">"):
        plain_text(text), metadata_fields(text)
    assert time.monotonic() - start < 10


PAGES = [
    "<html lang=en><title>A &amp; b</title><meta charset='utf-8'><a class=x href=\"u>v\">t</a><A HREF = w>z</a>", "<a name=q><a <a href='1'>x", "<a href=>y", "<a href='open>z",
    "<title>no end", "<title <title>x</title>y</title>", "<html><html lang='de'><p>one<p>two<!-- c", "a < b <b and <!-- gone", "x <b never ended", "<?pi <!doctype", "<script>a</script", "<a href",
]


def test_fields_and_text_of_odd_pages():
    """Against the plain patterns that say what a page holds, searched from every place."""
    markup = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>|<[!?/][^>]*>", re.S | re.I)
    one = {
        "title": r"<title\b[^>]*>(.*?)</title\s*>",
        "language": r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)",
        "charset": r"<meta\b[^>]*?\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)",
    }
    link = r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
    for page in PAGES:
        want = [(k, html.unescape(m[1])) for k, p in one.items() if (m := re.search(p, page, re.S | re.I))]
        want += [("outlink", "".join(m)) for m in re.findall(link, page, re.I)]
        assert metadata_fields(page) == "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in want), page
        kept = markup.sub(lambda m: ("\n" if m[3].lower() in BLOCKS else "") if m[3] else " ", page)
        assert plain_text(page).split() == html.unescape(kept).split(), page


def test_short_items_and_short_passages_are_found(make_docs, spark):
    item = prose(7, 80).replace("\n", " ")
    items = spark.createDataFrame([(1, item), (2, "Thirteen char"), (3, "Twelve chars")], "item_id long, text string")
    rows = [(at, "Before it. " + item[at : at + WINDOW + STEP] + " Behind it.") for at in range(0, 60)]
    rows += [(100, "x thirteen char y"), (101, "x thirteen chat y"), (102, "twelve chars")]
    got = {(r.doc_id, r.item_id) for r in contaminated(make_docs(rows), items).collect()}
    assert got == {*((at, 1) for at in range(60)), (100, 2)}


def test_repeated_grams_are_counted_in_bounded_runs(monkeypatch):
    text = prose(8, 400)
    index = window_index([(1, "-" * 100), (2, text[200:400]), (3, "ab" * 60)], Q, WINDOW, STEP, EDITS)
    whole = "-" * 700 + text + "ab" * 300 + "-" * 90
    want = sorted(search(index, [whole, text]))
    monkeypatch.setattr("fleetratio.llm.qgram_decontamination.HITS", 500)
    assert sorted(search(index, [whole, text])) == want and len({w for _, w, *_ in want}) == len(index.item)


# ---- components


def test_components_of_chains_stars_and_cycles(spark):
    rng, pairs = random.Random(1), []
    chain = list(range(100, 160))
    rng.shuffle(chain)
    pairs += list(zip(chain, chain[1:]))
    pairs += [(1, k) for k in range(2, 40)] + [(50, 51), (51, 52), (52, 50), (7, 7), (50, 51)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in chain}, **{k: 1 for k in range(1, 40)}, 50: 50, 51: 50, 52: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- lines


def line_classes(docs):
    """Places of removed lines for each (id, text), by comparing all lines."""
    order = sorted({(LAST if i is None else i, xxhash.xxh64_intdigest(t.encode(), 42) if False else t, i) for i, t in docs}, key=lambda d: d[:2])
    first = {}
    for number, (_, t, _) in enumerate(order):
        for place, line in enumerate(t.split("\n")):
            if WORD.search(line):
                first.setdefault(line, (number, place))
    lines = list(first)
    sets, top = [shingles(x, 7) for x in lines], list(range(len(lines)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(lines)):
        for b in range(a):
            if similar(sets[a], sets[b], 0.8):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    keep = {}
    for k, line in enumerate(lines):
        keep[root(k)] = min(keep.get(root(k), first[line]), first[line])
    where = {line: keep[root(k)] for k, line in enumerate(lines)}
    return {(i, t): [p for p, line in enumerate(t.split("\n")) if WORD.search(line) and where[line] != (n, p)] for n, (_, t, i) in enumerate(order)}


def test_lines_against_all_pairs(make_docs, corpus):
    """Banding may miss a pair near the threshold, never invent one."""
    want = line_classes([(i, t or "") for i, t in corpus])
    got = {r.doc_id: r for r in line_report(make_docs(corpus)).collect()}
    removed = {i: {int(x) for x in got[i].removed.split(",") if x} for i, _ in corpus}
    truth = {i: set(want[i, t or ""]) for i, t in corpus}
    assert all(removed[i] <= truth[i] for i in truth)
    assert sum(map(len, removed.values())) >= 0.99 * sum(map(len, truth.values())) > 20
    assert all(got[i].n_removed == len(removed[i]) for i in truth)


def test_one_fuzzy_line_of_a_component_stays(make_docs):
    line = "This is the license line number 4711 of the famous project, all rights are reserved by it."
    rows = [(1, "Own text of one.\n" + line), (2, line.replace("4711", "4712") + "\n\nOwn text of two."), (3, line + "\n" + line), (None, line)]
    cleaned = {r.doc_id: r.text for r in drop_duplicate_lines(make_docs(rows)).collect()}
    assert cleaned == {1: rows[0][1], 2: "\nOwn text of two.", 3: "", None: ""}


def test_repeated_lines_are_banded_once(make_docs, monkeypatch):
    banded, seen = fuzzy_lines._buckets, []
    monkeypatch.setattr(fuzzy_lines, "_buckets", lambda lines, *a: seen.append(lines.count()) or banded(lines, *a))
    line = "A very common line of the whole corpus, which all the documents in it repeat."
    rows = [(i, line + "\n" + line) for i in range(50)] + [(50, line.replace("common", "commons"))]
    removed = {r.doc_id: r.removed for r in line_report(make_docs(rows)).collect()}
    assert seen == [2]
    assert removed == {0: "1", **{i: "0,1" for i in range(1, 50)}, 50: "0"}


def test_only_contents_of_candidates_are_shuffled_again(spark, make_docs, monkeypatch):
    """Of 3,001 lines two share buckets: a bit set leaves the others out before contents are dealt out a second time."""
    store, plans = fuzzy_lines.stored, {}

    def stored(df, name):
        plans.setdefault(name, df._jdf.queryExecution()).executedPlan().toString()
        return store(df, name)

    monkeypatch.setattr(fuzzy_lines, "stored", stored)
    rng = random.Random(9)
    own = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(3000)]
    near = own[0][:58] + "#" + own[0][59:]
    rows = [(k, "\n".join(own[k * 30 : k * 30 + 30])) for k in range(100)] + [(100, near + "\n" + own[1])]
    removed = {r.doc_id: r.removed for r in line_report(make_docs(rows)).collect()}
    assert removed == {**dict.fromkeys(range(100), ""), 100: "0,1"}
    plan = plans["candidate-lines"].optimizedPlan().toString()
    before_combining = plan[plan.index("first(content") :]  # a plan reads from its end
    assert "__bits" in before_combining


def test_contents_are_shuffled_after_the_bit_set_whatever_is_broadcast(spark, make_docs, monkeypatch):
    """The join with the exact hashes comes after contents are combined: before, Spark moved it to the lines themselves."""
    store, plans = fuzzy_lines.stored, {}

    def stored(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return store(df, name)

    monkeypatch.setattr(fuzzy_lines, "stored", stored)
    line = "A line of some words that comes again in another form in the second text."
    line_report(make_docs([(1, line), (2, line.replace("some", "home"))])).collect()
    plan = plans["candidate-lines"]
    assert "LeftSemi" not in plan
    assert plan.index("Join Inner") < plan.index("first(content") < plan.index("__bits")


def test_buckets_travel_packed(spark):
    """Ten buckets a line: 20,000 rows before; packed, no more than a row for each part and batch."""
    lines = spark.createDataFrame([(k, f"the line number {k} of the text {k * k}") for k in range(2000)], "line long, content string").coalesce(1)
    packed = [(r.part, bytes(r.packed)) for r in fuzzy_lines._buckets(lines, 7, 10, 4).collect()]
    assert len(packed) <= fuzzy_lines.PARTS
    rows = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 2) for _, b in packed])
    assert rows.shape == (20000, 2) and sorted(rows[:, 1].tolist()) == sorted(list(range(2000)) * 10)
    assert all((np.frombuffer(b, np.int64)[::2] % fuzzy_lines.PARTS == part).all() for part, b in packed)


def test_crowded_buckets_do_not_depend_on_batches():
    """One bucket holds most rows; the rest are alone, in pairs or more, over several parts."""
    rng = random.Random(8)
    rows = [(3 if rng.random() < 0.5 else rng.randint(-300, 300), k) for k in range(900)]
    by_part = {}
    for b, x in rows:
        by_part.setdefault(b % fuzzy_lines.PARTS, []).append((b, x))
    cells = []
    for part, some in sorted(by_part.items()):
        while some:
            n = rng.randint(1, 9)
            cells.append({"part": part, "packed": np.array(some[:n], np.int64).tobytes()})
            some = some[n:]
    sizes = Counter(b for b, _ in rows)
    want = sorted(r for r in rows if sizes[r[0]] > 1)
    assert 1 in sizes.values()
    for size in (1, 2, 3, 7, 50, len(cells)):
        batches = [pa.RecordBatch.from_pylist(cells[at : at + size]) for at in range(0, len(cells), size)]
        assert sorted(tuple(r.values()) for out in fuzzy_lines._crowded(iter(batches)) for r in out.to_pylist()) == want


def test_sorted_codes_compare_like_sets(monkeypatch):
    """Short and long lines, NUL, more characters than have a code, and blocks of few pairs."""
    rng = random.Random(12)
    wide = "".join(chr(0x4E00 + k) for k in range(700))
    lines = ["a", "ab", "\0", "\0\0", "a\0", "ab" * 300, "é𝄞" * 30, wide, wide[:690] + "x" * 10, *("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 300))) for _ in range(60))]
    lines += [x[: len(x) // 2] + "#" + x[len(x) // 2 + 1 :] for x in lines]
    left, right = zip(*[(x, y) for x in lines for y in lines])
    want = [similar(shingles(x, 7), shingles(y, 7), 0.8) for x, y in zip(left, right)]
    assert len(lines) < sum(want) < len(want)
    for chars in (1, 2000, 1 << 18):
        monkeypatch.setattr(fuzzy_lines, "PAIR_CHARS", chars)
        assert fuzzy_lines.similar_pairs(list(left), list(right), 7, 0.8).tolist() == want
    assert fuzzy_lines.similar_pairs([], [], 7, 0.8).tolist() == []


def test_sketches_rule_out_long_lines():
    """Unlike lines of 2,000 characters: with 512 cells their sketches differed in too few of them to tell."""
    rng = random.Random(13)
    sketches, sizes = fuzzy_lines.line_sketches(["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(20)], 7)
    for a, b in itertools.combinations(range(20), 2):
        assert np.bitwise_count(sketches[a] ^ sketches[b]).sum() > 0.2 / 1.8 * (sizes[a] + sizes[b])


def test_shared_buckets_do_not_depend_on_batches():
    rng = random.Random(5)
    rows = sorted((rng.randint(0, 40) ** 2 // 40, rng.randint(-9, 9)) for _ in range(400))
    lines = {b: sorted({x for c, x in rows if c == b}) for b, _ in rows}
    want = [(b, x, xs[0]) for b, xs in lines.items() if len(xs) > 1 for x in xs]
    for size in (1, 2, 3, 7, 50, 400):
        batches = [pa.RecordBatch.from_pydict({"bucket": [r[0] for r in rows[at : at + size]], "line": [r[1] for r in rows[at : at + size]]}) for at in range(0, len(rows), size)]
        got = [tuple(r.values()) for out in fuzzy_lines._shared(iter(batches)) for r in out.to_pylist()]
        assert got == want


def test_sketches_bound_the_difference_of_lines():
    rng = random.Random(11)
    lines = ["", "abc", "é" * 40, "ab" * 300, *("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 200))) for _ in range(300))]
    lines += [x[:50] + "#" + x[51:] for x in lines]
    sketches, sizes = fuzzy_lines.line_sketches(lines, 7)
    sets = [shingles(x, 7) for x in lines]
    assert all(n >= len(s) for n, s in zip(sizes, sets))
    for _ in range(3000):
        a, b = rng.randrange(len(lines)), rng.randrange(len(lines))
        assert np.bitwise_count(sketches[a] ^ sketches[b]).sum() <= len(sets[a] ^ sets[b])


def test_lines_of_a_mixed_bucket_meet(spark):
    """Every line in one bucket, whose leader is like none of them: all links come from the comparison inside it."""
    rng = random.Random(4)
    lines = ["0 the leader of the bucket", *("".join(rng.choice("abcdefgh ") for _ in range(80)) for _ in range(12))]
    lines += [x[:70] + str(k) + x[71:] for k in range(3) for x in lines[1:]]
    rows = [{"bucket": 5, "low": 0, "high": 0, "line": k, "root": k, "content": x, "leader": 0} for k, x in enumerate(lines)]
    want = {frozenset(k for k in range(1, len(lines)) if lines[k][:70] == x[:70]) for x in lines[1:]}
    got = {k: {k} for k in range(len(lines))}
    for out in fuzzy_lines._cross_links(iter(pa.RecordBatch.from_pylist(rows[k : k + 7]) for k in range(0, len(rows), 7)), 7, 0.8):
        for r in out.to_pylist():
            both = got[r["a"]] | got[r["b"]]
            got.update(dict.fromkeys(both, both))
    assert {frozenset(v) for k, v in got.items() if k} == want


def test_lines_of_awkward_rows(awkward, awkward_rows, nothing):
    cleaned = drop_duplicate_lines(awkward)
    assert cleaned.columns == awkward.columns and cleaned.count() == len(awkward_rows)
    texts = Counter((r.doc_id, r.text) for r in cleaned.collect())
    assert texts[1, awkward_rows[0][1]] == 1 and texts[7, ""] == 1 and texts[4, None] == 1 and texts[6, " \n\t\n "] == 1
    assert texts[10, ""] == 2 and texts[None, ""] == 1  # the text of 2 again, twice under one id, once without
    assert line_report(awkward).count() == len(awkward_rows)
    assert drop_duplicate_lines(nothing).count() == line_report(nothing).count() == 0


# ---- SimHash


def plain_fingerprint(t):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(corpus, awkward_rows):
    for _, t, *_ in [*corpus, *awkward_rows, (0, "ÀÉ Ab c D"), (0, "One two"), (0, " \t ")]:
        assert fingerprint(t or "") == plain_fingerprint(t or "")


def all_components(fps, limit):
    label = list(range(len(fps)))
    for _ in fps:
        before = list(label)
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= limit:
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_links_connect_all_within_the_limit(spark):
    """Random and chained fingerprints, and a dense cluster that is cut into tiles."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for base in list(fps)[:40]:
        for _ in range(3):
            base ^= sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 6))})
            fps.add(base)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), 4).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in links)
    at = {signed(f): k for k, f in enumerate(fps)}
    label = list(range(len(fps)))
    for _ in fps:
        for r in links:
            label[at[r.a]] = label[at[r.b]] = min(label[at[r.a]], label[at[r.b]])
    assert label == all_components(fps, 4)


def test_near_duplicates_of_awkward_rows(awkward, awkward_rows, nothing, make_docs, corpus):
    rows = [*awkward_rows, *[(i + 100, t) for i, t in corpus]]
    docs = make_docs(rows)
    got = near_duplicates(docs).collect()
    fps = [plain_fingerprint(t or "") for _, t, *_ in rows]
    label = all_components(fps, 4)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    want = Counter((i, fps[k], least.get(label[k])) for k, (i, *_) in enumerate(rows))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert len({all_components([*fps], 4)[rows.index(next(x for x in rows if x[0] == r.doc_id and x[1] == r.text))] for r in kept.collect()}) == len(set(label))
    assert near_duplicates(nothing).count() == keep_one_each(nothing).count() == 0


# ---- decontamination


def fit(pattern, text):
    """Least edits to fit the whole pattern somewhere into the text, and the first place where that ends."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        left, row2 = i, [i]
        for j, t in enumerate(text, 1):
            left = min(row[j - 1] + (p != t), row[j] + 1, left + 1)
            row2.append(left)
        row = row2
    best = min(row)
    return best, row.index(best)


def test_banded_alignment_is_exact_inside_the_band():
    rng = random.Random(2)
    for _ in range(60):
        pattern = [rng.randint(1, 3) for _ in range(12)]
        region = [rng.randint(1, 3) for _ in range(12 + 24)]
        edits, end = banded_edits(np.array([pattern]), np.array([region]))
        row = {d: 0 for d in range(25)}  # by diagonal
        for i, p in enumerate(pattern):
            now = {}
            for d in row:
                now[d] = min(row[d] + (p != region[i + d]), row.get(d + 1, 99) + 1, now.get(d - 1, 99) + 1)
            row = now
        assert edits[0] == min(row.values()) and row[end[0] - 12] == edits[0]


def test_edited_passages_are_found(spark, make_docs):
    """Every window with no more edits than the budget is found, no other."""
    rng, item = random.Random(8), prose(500, 40)[:200].replace("\n", " ")
    rows, edits = [], {}
    for i in range(40):
        passage = list(item)
        for _ in range(i):
            k = rng.randrange(len(passage))
            passage[k : k + 1] = rng.choice([[], [passage[k], "q"], ["q"]])
        rows.append((i, prose(600 + i, 30) + " " + "".join(passage).upper() + "\n" + prose(700 + i, 20)))
        windows = [folded(item)[s : s + WINDOW].tolist() for s in [*range(0, len(item) - WINDOW, STEP), len(item) - WINDOW]]
        edits[i] = [fit(w, folded(rows[-1][1]).tolist())[0] for w in windows]
    index = window_index([(7, item)], Q, WINDOW, STEP, EDITS)
    found = {(t, w): e for t, w, _, e in sorted(search(index, [t for _, t in rows]), key=lambda f: -f[3])}
    assert found == {(i, w): e for i, all_ in edits.items() for w, e in enumerate(all_) if e <= EDITS}
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "too short"), (11, prose(501, 40))], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_windows, r.edits) for r in contaminated(make_docs(rows), bench).collect()}
    assert got == {(i, 7, sum(e <= EDITS for e in all_), min(all_)) for i, all_ in edits.items() if min(all_) <= EDITS}
    clean = drop_contaminated(make_docs(rows), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, all_ in edits.items() if min(all_) > EDITS}


def test_decontamination_of_awkward_rows(spark, awkward, awkward_rows, nothing):
    bench = spark.createDataFrame([(1, awkward_rows[0][1])], "item_id long, text string")
    got = Counter((r.doc_id, r.edits) for r in contaminated(awkward, bench).collect())
    assert got == Counter({(1, 0): 1, (7, 0): 1, (8, 0): 1})
    clean = drop_contaminated(awkward, bench)
    assert clean.columns == awkward.columns and clean.count() == len(awkward_rows) - 3
    assert contaminated(nothing, bench).count() == 0 and drop_contaminated(awkward, bench.limit(0)).count() == len(awkward_rows)


def test_index_of_a_large_benchmark_takes_little_memory():
    """A q-gram lies in seven windows: held once for each, 2 million characters took a gigabyte on the driver."""
    items = [(k, prose(600 + k, 100)) for k in range(500)]
    chars = sum(len(t) for _, t in items)
    window_index(items[:1], Q, WINDOW, STEP, EDITS)
    tracemalloc.start()
    index = window_index(items, Q, WINDOW, STEP, EDITS)
    peak = tracemalloc.get_traced_memory()[1] - index.member.nbytes
    tracemalloc.stop()
    assert chars > 250_000 and peak < 120 * chars
    assert len(pickle.dumps(index, 5)) - index.member.nbytes < 60 * chars


def test_index_counts_each_window_over_a_gram():
    items = [(1, "ab" * 70), (2, prose(503, 60).replace("\n", " ")), (3, "short item of two dozen"), (4, "x" * Q), (5, "")]
    for settings in ((Q, WINDOW, STEP, EDITS), (4, 20, 30, 2)):  # with wide steps some places lie in no window
        q, window, step, _ = settings
        index, want, at = window_index(items, *settings), Counter(), 0
        for _, text in items:
            wide = min(window, len(text))
            for s in sorted({*range(0, len(text) - wide, step), len(text) - wide}) if len(text) > q else []:
                assert (index.begin[at] - index.begin[0], index.width[at]) == (sum(len(t) for _, t in items[: index.item[at] - 1]) + s, wide)
                want.update(text[p : p + q] for p in range(s, s + wide - q + 1))
                at += 1
        assert at == len(index.item) and sorted(want.values()) == sorted(index.count.tolist())


def test_blocks_of_a_benchmark_give_what_one_block_gives(make_docs, spark, monkeypatch):
    items = [(k, prose(510 + k, 60)) for k in range(4)] + [(None, prose(515, 60))]
    docs = make_docs([(1, items[0][1] + items[3][1][:200]), (2, "x" + items[2][1]), (2, items[4][1]), (3, prose(520, 80)), (4, None)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, contaminated(docs, bench).collect()))
    ended, destroy = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (ended.append(self), destroy(self, *a)))
    monkeypatch.setattr("fleetratio.llm.qgram_decontamination.BLOCK_CHARS", 700)
    found = contaminated(docs, bench)
    assert len(ended) >= 3  # no index stays on the driver and the executors
    assert sorted(map(str, found.collect())) == want and len(want) == 4


def test_passage_does_not_run_over_two_documents(make_docs, spark):
    item = prose(502, 40)[:160]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    index = window_index([(1, item)], Q, WINDOW, STEP, EDITS)
    assert search(index, [item[:60], item[60:120], item[120:]]) == []
    assert contaminated(make_docs([(1, item[:60]), (2, item[60:120]), (3, "\0" + item)]), bench).count() == 1


# ---- sentence spans


def sentence_spans(docs):
    seen, gone = set(), {}
    for i, t in docs:
        pieces = sentence_pieces(t)
        worded = [(k, tuple(p.encode().lower().split())) for k, p in enumerate(pieces) if WORD.search(p)]
        for s in range(len(worded)):
            e = s
            while e < len(worded) and (e - s < 2 or sum(len(w) for _, w in worded[s:e]) < 15):
                e += 1
            if e - s < 2 or sum(len(w) for _, w in worded[s:e]) < 15:
                break
            key = tuple(w for _, ws in worded[s:e] for w in (*ws, None))
            if key in seen:
                gone.setdefault(i, set()).update(range(worded[s][0], worded[e - 1][0] + 1))
            seen.add(key)
    return gone


def test_sentence_spans_against_brute_force(make_docs, corpus):
    want = sentence_spans([(i, t or "") for i, t in corpus])
    got = {r.doc_id: set(r.removed) for r in repeated_sentences(make_docs(corpus)).collect()}
    assert got == want and {60, 61, 63, 64} <= set(got)
    cleaned = {r.doc_id: r.text for r in drop_repeated_sentences(make_docs(corpus)).collect()}
    for i, t in corpus:
        assert cleaned[i] == (t if t is None else "".join(p for k, p in enumerate(sentence_pieces(t)) if k not in want.get(i, ())))


def all_repeated_runs(docs):
    """Pieces of every run of two sentences and fifteen words or more that is not its first occurrence."""
    seen, gone = {}, {}
    for i, t in docs:
        pieces = sentence_pieces(t)
        worded = [(k, tuple(p.encode().lower().split())) for k, p in enumerate(pieces) if WORD.search(p)]
        for s in range(len(worded)):
            for e in range(s + 2, len(worded) + 1):
                if sum(len(w) for _, w in worded[s:e]) >= 15:
                    if seen.setdefault(tuple(w for _, w in worded[s:e]), (i, s)) != (i, s):
                        gone.setdefault(i, set()).update(range(worded[s][0], worded[e - 1][0] + 1))
    return gone


def test_both_ends_cover_every_repeated_run(make_docs, corpus):
    passage = " ".join(" ".join(f"w{k}{i}" for i in range(n)) + "." for k, n in enumerate((20, 20, 8, 4)))
    rows = [*corpus, (70, passage + " One goes on in this way."), (71, passage + " Another goes on in that way."), (72, "Two words. " + passage)]
    got = {r.doc_id: set(r.removed) for r in repeated_sentences(make_docs(rows), both_ends=True).collect()}
    assert got == all_repeated_runs([(i, t or "") for i, t in rows])
    assert got[71] == {0, 1, 2, 3} and got[72] == {1, 2, 3, 4} and 70 not in got


@pytest.mark.parametrize("floor", [1, 2])
def test_hot_spans_stay_where_they_are(make_docs, corpus, monkeypatch, floor):
    """All repeated spans are hot, or only those in three places or more: the result stays that of brute force."""
    monkeypatch.setattr("fleetratio.llm.sentence_spans.HOT_FLOOR", floor)
    shared = "One two three four five six seven eight. Nine ten eleven twelve thirteen fourteen fifteen sixteen."
    rows = [*corpus, *[(100 + i, shared) for i in range(30)], (200, shared + " " + shared)]
    got = {r.doc_id: set(r.removed) for r in repeated_sentences(make_docs(rows), both_ends=True).collect()}
    assert got == all_repeated_runs([(i, t or "") for i, t in rows])
    assert 100 not in got and all(got[100 + i] == {0, 1} for i in range(1, 30))


def test_sentence_spans_of_awkward_rows(awkward, awkward_rows, nothing):
    cleaned = drop_repeated_sentences(awkward)
    assert cleaned.columns == awkward.columns and cleaned.count() == len(awkward_rows)
    texts = Counter((r.doc_id, r.text) for r in cleaned.collect())
    assert texts[7, ""] == 1 and texts[1, awkward_rows[0][1]] == 1 and texts[4, None] == 1
    assert repeated_sentences(nothing).count() == drop_repeated_sentences(nothing).count() == 0


# ---- suffix arrays


def test_two_stage_order_is_the_order_of_the_suffixes():
    rng = random.Random(4)
    for alphabet in (b"ab", b"abc\x00\xff", b"z"):
        regions = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(30)]
        text, ends = np.frombuffer(b"".join(regions), np.uint8), np.repeat(np.cumsum([len(r) for r in regions]), [len(r) for r in regions])
        wanted = np.array([rng.random() < 0.6 for _ in range(len(text))])
        rank = two_stage_ranks(text, ends, wanted, 50)
        places = np.flatnonzero(wanted)
        order = places[np.argsort(rank[places])]
        suffixes = [text[p : ends[p]].tobytes() for p in order]
        assert suffixes == sorted(suffixes) and len(set(rank[places].tolist())) == len(places)


def cut(docs, length=50):
    out, seen = {}, {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b, mark = t.encode(), bytearray(len(t.encode()))
        for k in range(len(b) - length + 1):
            if seen.setdefault(b[k : k + length], i) < i:
                mark[k : k + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out.setdefault(i, []).append((len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


def test_strings_against_brute_force(make_docs, corpus):
    want = cut([(i, t or "") for i, t in corpus])
    got = {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in remove_repeated_strings(make_docs(corpus)).collect()}
    assert got == want and sum(v[0][1] for v in got.values()) > 3000


def test_strings_of_awkward_rows(awkward, awkward_rows, nothing):
    want = cut([(LAST if r[0] is None else r[0], r[1] or "") for r in awkward_rows])
    got = {}
    for r in remove_repeated_strings(awkward).collect():
        got.setdefault(LAST if r.doc_id is None else r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert remove_repeated_strings(nothing).count() == 0


@pytest.mark.parametrize("name", ["TILE", "STARTS", "PIECE", "CHUNK"])
def test_strings_do_not_depend_on_sizes(make_docs, corpus, monkeypatch, name):
    """Many tiles of one anchor, short regions, small pieces of texts and small chunks give the same."""
    from fleetratio.llm import suffix_two_stage

    monkeypatch.setattr(suffix_two_stage, name, {"TILE": 2, "STARTS": 3, "PIECE": 64, "CHUNK": 5}[name])
    want = cut([(i, t or "") for i, t in corpus])
    got = {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in remove_repeated_strings(make_docs(corpus)).collect()}
    assert got == want


# ---- WARC


PAGE = """<!DOCTYPE html><html lang="de"><head><meta charset="utf-8"><title>A &amp;
 B</title><style>p{}</style><script>x = "<p>no</p>";</script></head><body><!-- no --><h1>Head</h1><p>One <b>bold</b> &lt;word&gt;<br>two
three</p><ul><li><a href="/x?a=1&amp;b=2">link</a></li><li><a href='y'>other</a></ul><a name=z>no link</a></body></html>"""


def test_text_and_fields_of_a_page():
    assert plain_text(PAGE) == "A & B\nHead\nOne bold <word>\ntwo three\nlink\nother\nno link"
    assert plain_text("") == "" and plain_text("a < b <p>c") == "a < b \nc".replace(" \n", "\n")
    assert plain_text("<script>never closed") == ""


def test_records_link_to_their_response(spark):
    headers = {"Content-Type": "text/html; charset=utf-8", "Server": "x"}
    rows = [(1, "http://a/", PAGE, "<urn:uuid:1>", headers, "x"), (2, None, None, None, None, "x"), (2, None, None, None, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string, headers map<string,string>, content string")
    got = derive_records(pages).collect()
    assert len(got) == 6 and {r.record_type for r in got} == {"metadata", "conversion"}
    meta, text = (next(r for r in got if r.page_id == 1 and r.record_type == t) for t in ("metadata", "conversion"))
    assert meta.refers_to == text.refers_to == "<urn:uuid:1>" and meta.record_id != text.record_id
    assert meta.content == "title: A & B\r\nlanguage: de\r\ncharset: utf-8\r\noutlink: /x?a=1&b=2\r\noutlink: y\r\n"
    assert text.source_headers["Server"] == "x" and text.source_headers["Content-Type"].startswith("text/html; charset")
    for r in got:
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.content.encode()).digest()).decode()
        assert r.source_digest == r.source_headers["WARC-Payload-Digest"] and r.content_length == len(r.content.encode())
        head, _, rest = record_bytes(r.asDict()).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert fields["WARC-Refers-To"] == r.refers_to and rest == r.content.encode() + b"\r\n\r\n" and int(fields["Content-Length"]) == len(r.content.encode())
    assert digest(PAGE.encode()) == meta.source_digest
    twice = [r for r in got if r.page_id == 2]
    assert len({r.record_id for r in twice}) == 2 and all(r.content == "" for r in twice)
    assert derive_records(pages.limit(0)).count() == 0
    assert derive_records(pages.select("page_id", "url", "html")).count() == 6


def test_pages_keep_their_digests(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = derive_records(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(got) == 2 * len(pages)
    assert all(r.source_digest == digest(pages[r.page_id].html.encode()) and r.target_uri == pages[r.page_id].url for r in got)


# ---- pipeline


def test_pipeline_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        rows = out.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        counts.append(len(rows))
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] > 0
    assert fingerprint_groups(docs) == docs.count()
    ran = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in ran} <= {r.doc_id for r in docs.collect()}
    assert [r.position for r in ran] == sorted(r.position for r in ran)
    target = {r.source: r.target for r in ran}
    taken = Counter()
    for r in ran:
        taken[r.source] += r.taken
    assert all(taken[s] == int(target[s]) for s in target)


def fingerprint_groups(docs):
    return len(set(all_components([plain_fingerprint(r.text or "") for r in docs.collect()], 4)))


def test_pipeline_of_an_empty_corpus(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
