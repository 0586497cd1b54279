"""Pattern packing, importance resampling and the Merkle manifest against brute force, with the awkward rows any input may hold."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracklight.llm import bestfit, merkle, resampling, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, src string, idx long, block int, slot int, score long"
WORDS = [a + b for a in ("ka", "lo", "Mi", "ter", "AN", "sho") for b in ("ra", "ne", "dut", "li", "os", "pe")]
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def rows(n=330, seed=5):
    """Documents of a hot source, small ones, a null one and one of a single row; null fields, shared ids, repeated rows."""
    rng = random.Random(seed)
    out = [(i * 3 - 20, sentence(rng, rng.randint(0, 60)), rng.choice(["en", None]), "hot" if i % 3 else rng.choice(["a", "é", "Z"]), i) for i in range(n)]
    odd = [None, "", " \n\t ", "don't  stop\n\n \t now ", "é ß 日本 🎉 \x1c x", "<|endoftext|> a", "A" * 3000, sentence(rng, 4000)]
    out += [(10_000 + i, t, "en", None if i % 2 else "hot", None if t is None else len(t)) for i, t in enumerate(odd)]
    out += [(5, "same", "en", "hot", 4)] * 20 + [(7, "one", "en", "hot", 3), (7, "two", "en", "hot", 3), (None, "no id", "en", "hot", 5), (None, None, None, None, None), (77, "lone", "x", "single", 4)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "s", 1, 2, 3, 4) for r in data], SCHEMA).repartition(5)


def packed(spark, data, capacity):
    tok = Tokenizer.from_file(BYTES)
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in data]
    got = bestfit.pack_patterns(frame(spark, data), BYTES, capacity=capacity).collect()
    cut = lambda n: [0, *range(n % capacity, n, capacity)] if n > capacity and n % capacity else list(range(0, n, capacity))
    want = Counter()
    for (doc, *_), x in zip(data, ids, strict=True):
        s = [*cut(len(x)), len(x)]
        want.update((doc, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(s, s[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(map(len, ids))


def test_pattern_packing_keeps_every_id(spark):
    n, total = packed(spark, rows(), 256)
    assert n <= 1.05 * total / 256 + 1
    assert packed(spark, rows(40), 64)[0] > 0
    assert bestfit.pack_patterns(frame(spark, []), BYTES).count() == 0


def test_patterns_and_residual():
    rng = np.random.default_rng(2)
    for n, mean in ((3000, 5.5), (30_000, 6.2), (7, 4)):
        lengths = np.clip(rng.lognormal(mean, 0.8, n).astype(int), 1, 1024)
        h = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        slots, seen, fill = bestfit.pattern_packing(h, 1024), Counter(), Counter()
        for i, (length, rank, seq, _) in enumerate(slots.tolist()):
            more = i + 1 < len(slots) and slots[i + 1, 0] == length
            k = (int(slots[i + 1, 1]) if more else h[length]) - rank
            seen[length] += k
            fill.update({seq + j: length for j in range(k)})
        assert seen == Counter(h) and max(fill.values()) <= 1024
        assert len(fill) <= 1.01 * max(lengths.sum() / 1024, (lengths > 512).sum()) + 1
    counts = np.zeros(11, np.int64)
    counts[[3, 4, 7, 10]] = (50, 20, 40, 5)
    found = bestfit.patterns(np.flatnonzero(counts), 10)
    assert found.tolist() == [[4, 3, 3], [7, 3, 0], [10, 0, 0]]
    assert np.round(bestfit.fit(found, counts, 10)).tolist() == [6, 39, 5] or bestfit.fit(found, counts, 10).min() >= 0


def test_fit_is_least_squares_without_negatives():
    """At the minimum no pattern gains from more or, where it is used, from fewer repeats."""
    rng = np.random.default_rng(3)
    counts = np.zeros(65, np.int64)
    counts[1:] = rng.integers(0, 200, 64)
    found = bestfit.patterns(np.flatnonzero(counts), 64)
    x, w = bestfit.fit(found, counts, 64), np.arange(65) / 64
    a = np.zeros((65, len(found)))
    for j, row in enumerate(found):
        for k in row[row > 0]:
            a[k, j] += w[k]
    slope = a.T @ (a @ x - counts * w)
    size = np.abs(a.T @ (counts * w)).max()
    assert x.min() >= 0 and slope.min() > -0.01 * size and np.abs(slope[x > 0.5]).max() < 0.01 * size


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(tokens, "PART", 100)
    rng, tok = random.Random(4), Tokenizer.from_file(BYTES)
    coder = tokens.ByteTokens(BYTES, 2)
    for t in (sentence(rng, 500).lower(), "ab  cd \n " * 200, "x" * 1000, "a b" * 300):
        assert coder.encode([t])[0].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2]


def brute_resampling(data, target):
    word, low = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def buckets(t):
        w = word.findall((t or "").translate(low))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own = [buckets(r[1]) for r in data]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in buckets(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for (doc, *_), (n, f) in zip(data, own, strict=True):
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    drawn = able[: 5 * len(able) // 100]
    got = Counter((r[0], r[2], r[3], r[4]) for r in out)
    return got, [(r[0], r[4], i + 1) for i, r in enumerate(drawn)]


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_resampling_by_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)  # parts of a text, in this process
    rng = random.Random(9)
    data = rows(600)
    target = [sentence(rng, 30) for _ in range(20)] + [None, ""]
    for t in (data[3][1], data[-8][1], data[-6][1], "one", ""):
        whole = Counter(b for _, f in resampling.features(t or "") for b in f.tolist())
        word = [w for x in resampling._word_lists(t or "") for w in x]
        assert whole == Counter(zlib.crc32(b" ".join(word[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(word) - n + 1))
    got = resampling.resample(frame(spark, data), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")).collect()
    want, drawn = brute_resampling(data, target)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == want
    assert sorted((r.doc_id, r.score, r.rank) for r in got if r.rank is not None) == sorted(drawn) and drawn


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(frame(spark, []), none).count() == 0
    assert resampling.resample(frame(spark, rows(30)), none).count() == len(rows(30))


def test_postings_round_trip():
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, resampling.WIDTH * 900, 5000))
    bucket, doc, count = key // 900, key % 900, rng.integers(1, 70_000, len(key))
    assert all((a == b).all() for a, b in zip(resampling._unpacked(resampling._packed(bucket, doc, count)), (bucket, doc, count), strict=True))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(data):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    coded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(coded(r[0]), coded(r[3]), coded(r[2]), coded(r[4]), coded(text))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    by = {}
    for r in data:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for at, s in enumerate(names):
        for j, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            digest, siblings = leaf(r, r[1].translate(low)) if hit else own, []
            for levels, k in ((trees[at], j), (top, at)):
                for level in levels[:-1]:
                    first = k // 16 * 16
                    run = level[first : first + 16]
                    siblings += run[: k - first] + run[k - first + 1 :]
                    digest = sha(*run[: k - first], digest, *run[k - first + 1 :])
                    k //= 16
            out.append((r[0], own, trees[at][-1][0], top[-1][0], sha(*siblings), digest, digest == top[-1][0]))
    return Counter(out)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("bound", [merkle.BROADCAST, 0])
def test_manifest_by_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(merkle, "BROADCAST", bound)
    data = rows(900)
    got = Counter(tuple(r[c] for c in COLUMNS) for r in merkle.manifest(frame(spark, data)).collect())
    assert got == brute_manifest(data)
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_small_manifests(spark, n):
    data = [(i, f"Text {i}", "en", "s", 6) for i in range(n)]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in merkle.manifest(frame(spark, data)).collect()) == brute_manifest(data)
    many = [(i, f"Text {i}", "en", f"s{i}", 6) for i in range(n)]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in merkle.manifest(frame(spark, many)).collect()) == brute_manifest(many)
    assert merkle.manifest(frame(spark, [])).count() == 0


def test_manifest_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = {tuple(r[k] for k in COLUMNS) for r in merkle.op13_merkle(spark, sf).collect()}
    assert got == {tuple(r) for r in c.sql(f"select {', '.join(COLUMNS)} from ({merkle.oracle()})").fetchall()}


def site(rng, n, host="h"):
    """Pages with unmarked text only: a menu on all, paragraphs on shares of them, and own text."""
    menu = sentence(rng, 12)
    shared = {k: sentence(rng, 30) for k in (2, 3, 4, 5, 6, n // 3, n // 2)}
    out = []
    for i in range(n):
        some = [t for k, t in shared.items() if i < k]
        out.append((i, f"http://{host}/{i}", [menu, sentence(rng, 20), *some, sentence(rng, 9)], [menu, *some]))
    return out, menu, shared


def brute_text(pages):
    """Blocks of which nine tenths lie in runs of eight tokens that a fiftieth of the pages have, and four at least, go."""
    runs = [Counter() for _ in pages]
    streams = [[w for b in blocks for w in [*b.split(), "\n"]] for _, _, blocks, _ in pages]
    for c, s in zip(runs, streams, strict=True):
        c.update({tuple(s[i : i + 8]) for i in range(len(s) - 7)})
    count = Counter(r for c in runs for r in c)
    often = {r for r, n in count.items() if n >= max(4, math.ceil(0.02 * len(pages)))}
    out = {}
    for (i, _, blocks, _), s in zip(pages, streams, strict=True):
        hit = [False] * len(s)
        for k in range(len(s) - 7):
            if tuple(s[k : k + 8]) in often:
                hit[k : k + 8] = [True] * 8
        at, keep = 0, []
        for b in blocks:
            m = len(b.split())
            if sum(hit[at : at + m]) < 0.9 * m:
                keep.append(b)
            at += m + 1
        out[i] = " ".join(keep)
    return out


@pytest.mark.parametrize("n", [6, 12, 210])
def test_boilerplate_is_the_same_whatever_the_slices(spark, n):
    from tracklight.llm import htmltext

    pages, menu, _ = site(random.Random(n), n)
    html = [(i, u, "".join(f"<div>{b}</div>" for b in blocks)) for i, u, blocks, _ in pages]
    want = brute_text(pages)
    assert not any(menu in t for t in want.values())
    for chars in (htmltext.SLICE, 4000, 1):
        got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(html, "page_id long, url string, html string"), chars).collect()}
        assert got == want


def test_text_of_few_pages_stays(spark):
    from tracklight.llm import htmltext

    rng = random.Random(3)
    twice = sentence(rng, 30)
    rows = [(i, f"http://h/{i}", f"<div>{sentence(rng, 25)}</div>" + (f"<p>{twice}</p>" if i < 2 else "")) for i in range(6)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert twice in got[0] and twice in got[1]


def test_class_words_take_nothing_from_articles():
    from tracklight.llm.htmltext import blocks, decided

    page = '<h1>Beside</h1><article><header class="post-header"><h1>Title</h1></header><p class="legal">One</p><div class="copyright-law side"><p>Two</p></div><div class="ad">no</div><aside>no</aside><div class="Comments">no</div><footer>no</footer></article><div class="side-bar">no</div><div>Last</div><header>no</header>'
    none = np.zeros(0, np.uint64)
    assert decided(blocks(page), none, none)[0] == "Beside Title One Two Last"


def test_crowded_passages_are_found(spark):
    """Copies with 12 % of the words changed, whose passage's ten-word phrases stand in an earlier and a later document each."""
    from tracklight.llm import passages

    rng = random.Random(21)
    data, copies = [], []
    for k in range(40):
        passage = sentence(rng, 100).split()
        base = 1000 * k
        phrases = [passage[i : i + 10] for i in range(0, 91, 5)]
        data += [(base + i, f"{sentence(rng, 30)} {' '.join(x)} {sentence(rng, 30)}") for i, x in enumerate(phrases)]
        data.append((base + 100, f"{sentence(rng, 30)} {' '.join(passage)} {sentence(rng, 30)}"))
        data += [(base + 200 + i, f"{sentence(rng, 30)} {' '.join(x)} {sentence(rng, 30)}") for i, x in enumerate(phrases)]
        changed = set(rng.sample(range(100), 12))
        data.append((base + 300, f"{sentence(rng, 20)} {' '.join('new' + w if i in changed else w for i, w in enumerate(passage))} {sentence(rng, 20)}"))
        copies.append(base + 300)
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    found = [sum(max(0, min(s["end"], 120) - max(s["start"], 20)) for s in got[c].spans) for c in copies]
    assert sum(f >= 80 for f in found) >= 36, sorted(found)
    assert not any(got[i].n_dup_words for i, _ in data if i % 1000 < 100 or 200 <= i % 1000 < 300)


def test_links_in_parts_are_those_of_the_whole():
    from tracklight.llm.passages import RARE, star

    rng = np.random.default_rng(5)
    n = 4000
    h = np.append(rng.integers(0, 900, n - 300), np.full(300, 7)).astype(np.uint64)
    doc, pos = rng.integers(0, 400, n), rng.integers(0, 50, n).astype(np.int32)
    pairs = lambda links: set(zip(*(links[c].tolist() for c in ("doc", "src")), strict=True))
    whole, _ = star(h, doc, pos)
    rest, got = np.zeros(0, np.int64), []
    for part in np.array_split(np.arange(n), 7):
        at = np.concatenate([rest, part])
        links, stay = star(h[at], doc[at], pos[at], old=len(rest))
        got.append(pairs(links))
        rest = at[stay]
    docs_of = {k: sorted(set(doc[h == k].tolist())) for k in range(900)}
    all_pairs = {(b, a) for d in docs_of.values() if len(d) <= RARE for i, b in enumerate(d) for a in d[:i]}
    assert all_pairs <= pairs(whole) and all_pairs <= set().union(*got)
    assert pairs(whole) <= all_pairs | {(b, a) for d in docs_of.values() if len(d) > RARE for i, b in enumerate(d) for a in (d[0], d[i - 1]) if i}
