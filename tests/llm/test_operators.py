"""The text operators against brute force on small fixtures, with the awkward rows that any input may hold."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tracklight.llm import bpe, components, fingerprints, htmltext, licenses, linededup, packing, passages, quality, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, key string, h long, part int"
WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "an", "sho") for b in ("ra", "ne", "dut", "li", "os", "pe")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def texts(seed=3, n=40):
    """Documents with copies, near copies, shared lines and passages, and odd texts."""
    rng = random.Random(seed)
    out = ["\n".join(sentence(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 8))) for _ in range(n)]
    passage = sentence(rng, 70)
    for i in range(0, n, 5):
        out.append(out[i])
        words = out[i].split(" ")
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
        out.append(sentence(rng, 20) + " " + passage + " " + sentence(rng, 20))
    return [*out, None, "", " \n\t ", "one", "é ß 日本 🎉 \x1c", "a\n\nb\na", sentence(rng, 6000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "w", "k", 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return [(7 * i + 1, t) for i, t in enumerate(texts())]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, found = Tokenizer.from_file(path), packing.pack(frame(spark, docs), path, capacity=512).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs}
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert {i: sorted((r.start, r.length) for r in p) for i, p in pieces.items()} == {i: [(s, min(512, len(x) - s)) for s in range(0, len(x), 512)] for i, x in ids.items()}
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert len(sequences) <= 1.1 * sum(map(len, ids.values())) / 512 + 1


def test_shortest_pack_first_places_each_piece_once():
    rng = random.Random(1)
    h = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(60)}
    s = packing.shortest_pack_first(h, 100)
    fill = {}
    for length, n in h.items():
        own = s[s[:, 0] == length]
        ends = [*own[1:, 1], n]
        for (_, rank, seq, offset), end in zip(own.tolist(), ends, strict=True):
            for k in range(int(end) - rank):
                fill.setdefault(seq + k, []).append((offset, length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100


def test_bpe_equals_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    docs = [*docs, (9001, "x <|endoftext|> y"), (9002, "don't  I'LL\r\n ")]
    for r in bpe.encode_decode(frame(spark, docs), path).collect():
        ids = tok.encode(dict(docs)[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (",".join(map(str, ids)), len(ids))
        assert r.decoded == tok.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.digests(frame(spark, docs), path).collect()}
    assert got[9001].decoded_sha256 == hashlib.sha256(b"x <|endoftext|> y").hexdigest()


def test_quality_counts():
    t = "a b c\nx y\na b c\n\nx y # a"
    w = words(t)
    assert quality.text_stats(t) == (len(w), sum(map(len, w)), 1, 1, 10)
    assert quality.text_stats(None) == (0, 0, 0, 0, 0)


def test_repeat_words_by_brute_force():
    rng = random.Random(4)
    for _ in range(50):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        want = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(3)}
        assert quality.text_stats(" ".join(w))[4] == len(want)


def test_quality_and_toxicity_learn_from_labels(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        t = sentence(rng, 80)
        bad, toxic = i % 9 == 0, i % 5 == 0
        if bad:
            t = " ".join(x + "###" for x in t.split())
        if toxic:
            t = t.replace(" ", " vilename ", 1)
        rows.append((i, t))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None), (1001, "")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality_rules(frame(spark, rows), lab).collect()}
    assert kept[1000] == kept[1001] == (True, False)
    good = [i for i, q, _ in labels if q]
    assert sum(kept[i][1] for i in good) >= 0.97 * len(good)
    assert sum(not kept[i][1] for i, q, _ in labels if not q) >= 0.9 * sum(1 for x in labels if not x[1])
    tox = {r.doc_id: r.is_toxic for r in toxicity.toxicity(frame(spark, rows), lab).collect()}
    assert [i for i, v in sorted(tox.items()) if v] == [i for i, _, t in labels if t]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.is_toxic for r in toxicity.toxicity(frame(spark, rows), none).collect())
    assert sum(r.kept for r in quality.quality_rules(frame(spark, rows), none).collect()) == 400


def alike(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :])


def test_line_dedup_by_brute_force(spark, docs):
    rng = random.Random(8)
    base = sentence(rng, 9).split()
    edits = [" ".join(x) for x in (base, base[1:], [*base, "end"], [*base[:4], "zz", *base[5:]], [*base[:4], "yy", *base[5:]], base[2:], [base[0], "in", *base[1:]])]
    rows = [*docs, (9100, "\n".join(edits[:3])), (9101, "\n".join(edits[3:])), (9102, "\n".join(reversed(edits)))]
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    seen, near = [], 0
    for i, t in sorted(rows):
        out = []
        for line in (t or "").split("\n"):
            w = tuple(words(line))
            if w and any(alike(w, s) for s in seen):
                near += w not in seen
            else:
                out.append(line)
            if w:
                seen.append(w)
        assert got[i].text == (None if t is None else "\n".join(out)), i
        assert got[i].n_lines == (0 if t is None else len(t.split("\n")))
    assert near >= 4 and got[1].word == "w"


def test_fingerprints_by_brute_force(spark, docs):
    rows = sorted(docs)
    got = {r.doc_id: r for r in fingerprints.compare_edited(frame(spark, rows)).collect()}

    def cut(t, one_in, then=None):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        h = h if then is None else xxhash.xxh64_intdigest(then.encode(), h)
        return "\0" * ((h - (h >> 63 << 64)) % one_in == 0) + t

    def pieces(x):
        f, out = fingerprints, set()
        for line in x.split("\n"):
            if len(line) > f.LONG:
                words = re.split(r"(?<=[\x20\t])", line)
                line = "".join("".join(cut(c, f.CHARACTERS, w[k + 1 : k + 2]) for k, c in enumerate(w)) if len(w) > f.UNBROKEN else cut(w, f.WORDS) for w in words)
            out |= set(line.split("\0"))
        return out

    def like(x, y):
        a, b = pieces(x), pieces(y)
        return 1 - len(a ^ b) / (len(a) + len(b))

    same = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(t, e)) and r.near_next == pytest.approx(like(t, nxt))
        assert same.setdefault(t, r.fingerprint) == r.fingerprint
    assert max(r.near_next_tries for r in got.values()) <= fingerprints.RETRIES + 1


@pytest.mark.parametrize("alphabet", ["가나다라마바사아자차카타파하", "αβγδεζηθικλμνξοπρστυφχψω", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "กขคงจฉชซญฎฏฐณดตถทธนบป", "漢字文書指紋類似段落東西南北春夏秋冬", "abcdefghijklmnop", "😀😁😂🤣😃😄😅😆😉😊😋😎"])
def test_one_line_in_any_script_keeps_most_of_its_likeness(spark, alphabet):
    """Three quarters of the text stay: with and without spaces."""
    rng = random.Random(8)
    spaced = alphabet[0] not in "กข漢😀"
    line = lambda: "".join(rng.choice(alphabet) + (" " if spaced and rng.random() < 0.25 else "") for _ in range(1500))
    got = fingerprints.compare_edited(frame(spark, [(i, line()) for i in range(4)])).collect()
    assert all(0.5 < r.near_edited < 0.9 and r.near_next < 0.15 for r in got), [(r.near_edited, r.near_next) for r in got]


def test_sketch_retries_until_it_peels(spark):
    a, b = "\n".join(f"left {i}" for i in range(150)), "\n".join(f"right {i}" for i in range(150))
    got = fingerprints.compare_edited(frame(spark, [(1, a), (2, b)])).collect()
    assert [r.near_next for r in got] == [0.0, 0.0]


def test_simhash_by_brute_force(spark, docs):
    rng = np.random.default_rng(1)
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, docs)).collect()}
    fp = {i: simhash.fingerprint(t) for i, t in docs}
    assert {i: f"{v:016x}" for i, v in fp.items()} == {i: r.fingerprint for i, r in got.items()}
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: find(i) for i in fp} == {i: r.component_id for i, r in got.items()}
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    pts = np.unique(np.concatenate([base ^ sum((np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64) for _ in range(k)), np.uint64(0)) for k in range(6) for _ in range(8)]))
    a, b = simhash.GrayIndex(np.zeros(len(pts), np.int64), pts).links(4)
    near = [(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if int(pts[i] ^ pts[j]).bit_count() <= 4]
    want = simhash.forest(np.array([i for i, _ in near]), np.array([j for _, j in near]), len(pts))
    assert (simhash.forest(a, b, len(pts)) == want).all()


def edited(rng, text, share):
    return " ".join(f"new{rng.randint(0, 10**6)}" if rng.random() < share else w for w in text.split(" "))


def test_similar_documents_by_brute_force(spark):
    """Documents are linked at a Jaccard similarity of 0.8 of their five-word shingles or at four bits, and at nothing else."""
    rng = random.Random(8)
    rows = []
    for _ in range(150):
        base = sentence(rng, rng.randint(40, 400))
        rows += [base, *(edited(rng, base, share) for share in (0.005, 0.01, 0.02, 0.03, 0.06))]
    rows = [*enumerate(rows), (5000, None), (5001, ""), (5002, "a b"), (5003, "A b"), (None, rows[0]), (0, rows[0])]
    crowd = sentence(rng, 300)
    rows += [(6000 + i, edited(rng, crowd, 0.004)) for i in range(300)]  # one large group
    got = simhash.near_duplicates(frame(spark, rows), width=5, similarity=0.8).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows if i is not None}
    prints = {i: simhash.fingerprint(t, 5) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and ((sets[a] or sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 4)]
    ids = sorted(sets)
    at = {d: k for k, d in enumerate(ids)}
    root = simhash.forest(np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]), len(ids))
    want = {d: ids[root[at[d]]] for d in ids}
    assert all(want[d] == want[of[d]] for d in ids)  # no link too many
    single = [(a, b) for a, b in links if b < 5000]
    assert sum(of[a] == of[b] for a, b in single) >= 0.97 * len(single)
    assert {of[6000 + i] for i in range(300)} == {6000} and of[5000] == of[5001] == 5000 and of[5002] == of[5003] == 5002
    assert [r.stays for r in got if r.doc_id == 0] == [True, True] and [r.stays for r in got if r.doc_id is None] == [False]
    assert simhash.near_duplicates(frame(spark, []), width=5, similarity=0.8).count() == 0


def test_pivots_reach_all(spark):
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 30).repeat(8) ^ (1 << rng.integers(0, 62, 240))
    pairs = [(a, b) for x, y in simhash.pivot_links(fp, 4) for a, b in zip(x, y, strict=True)]
    assert {int(a) for a, _ in pairs} == set(range(240)) and max(int(fp[a] ^ fp[b]).bit_count() for a, b in pairs) <= 4


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}
    for a, b in edges:
        if a != b:
            x = {a, b} | {n for n in root if root[n] in (root.get(a, a), root.get(b, b))}
            root |= dict.fromkeys(x, min(root.get(n, n) for n in x))
    got = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == root
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_passages_by_brute_force(spark, docs):
    got = {r.doc_id: r for r in passages.repeated_passages(frame(spark, docs)).collect()}
    seen = set()
    for i, t in sorted(docs):
        w = [x.lower() for x in words(t)]
        grams = [tuple(w[k : k + 51]) for k in range(len(w) - 50)]
        inside = {k for s in got[i].spans for k in range(s["start"], s["end"])}
        for k, g in enumerate(grams):
            if g in seen:
                assert inside.issuperset(range(k, k + 51)), (i, k)
        seen.update(grams)
        assert got[i].n_words == len(w) and got[i].n_dup_words == len(inside)
        assert words(got[i].kept) == [x for k, x in enumerate(words(t)) if k not in inside]
    assert any(r.n_dup_words for r in got.values())
    fresh = [(i, sentence(random.Random(100 + i), 200)) for i in range(5)]
    assert all(r.n_dup_words == 0 and r.kept == r.text for r in passages.repeated_passages(frame(spark, fresh)).collect())


def test_fuzzy_passage_is_found_across_gaps(spark):
    rng = random.Random(6)
    a = sentence(rng, 120).split()
    b = [*a[:40], "new", *a[41:80], *a[82:]]
    got = {r.doc_id: r.n_dup_words for r in passages.repeated_passages(frame(spark, [(1, " ".join(a)), (2, " ".join(b))])).collect()}
    assert got[1] == 0 and got[2] >= 110


def test_passages_around_unlike_text_are_found(spark):
    """Two passages in the same order with unlike words between, and a copy with a block inserted or replaced."""
    rng = random.Random(12)
    rows, want = [], {}
    for k, gap in enumerate((30, 60, 100, 300)):
        a, b = sentence(rng, 100), sentence(rng, 100)
        rows += [(10 * k, f"{a} {sentence(rng, gap)} {b}"), (10 * k + 1, f"{a} {sentence(rng, gap)} {b}"), (10 * k + 2, f"{a} {sentence(rng, gap)} new {b}")]
        rows += [(10 * k + 3, f"{a} {sentence(rng, 2 * gap)} {b}"), (10 * k + 4, f"{a} {b}")]
        want |= {10 * k + j: (100, gap * (2 if j == 3 else 0 if j == 4 else 1) + (j == 2)) for j in range(1, 5)}
    got = {r.doc_id: r for r in passages.repeated_passages(frame(spark, rows)).collect()}
    for i, (n, gap) in want.items():
        inside = {k for s in got[i].spans for k in range(s["start"], s["end"])}
        assert inside >= {*range(n), *range(n + gap, 2 * n + gap)}, i


def test_passages_with_spread_edits_are_found(spark):
    """Passages of 60 to 120 words with 5 to 20 % of their words changed at random places, between words of their own."""
    rng, rows, share = random.Random(13), [], {}
    for case, (n, part) in enumerate(((60, 0.05), (60, 0.1), (60, 0.2), (80, 0.1), (80, 0.2), (120, 0.2))):
        for k in range(40):
            a = sentence(rng, n).split()
            b = a.copy()
            for at in rng.sample(range(1, n - 1), round(n * part)):
                b[at] = sentence(rng, 1) + "x"
            i = 1000 * case + 2 * k
            rows += [(i, f"{sentence(rng, 30)} {' '.join(a)} {sentence(rng, 30)}"), (i + 1, f"{sentence(rng, 30)} {' '.join(b)} {sentence(rng, 30)}")]
    got = {r.doc_id: r.n_dup_words for r in passages.repeated_passages(frame(spark, rows)).collect()}
    for case in range(6):
        share[case] = sum(got[1000 * case + 2 * k + 1] >= 50 for k in range(40)) / 40
    print("share found", share)
    assert min(share[c] for c in (0, 1, 3)) == 1 and share[5] >= 0.95 and min(share[2], share[4]) >= 0.8, share
    assert not any(got[i] for i, _ in rows if i % 2 == 0)


def test_passage_is_found_though_others_have_its_phrases(spark):
    """Document 90 repeats a passage of 80 with three of each 18 words changed; all phrases of it stand in earlier documents."""
    rng = random.Random(14)
    passage = sentence(rng, 87).split()
    phrases = [passage[i : i + 8] for i in range(0, 84, 4)]
    rows = [(i, f"{sentence(rng, 40)} {' '.join(x)} {sentence(rng, 40)}") for i, x in enumerate(phrases)]
    copy = [x if k % 18 < 15 else "new" + x for k, x in enumerate(passage)]
    rows += [(80, f"{' '.join(passage[20:30])} {sentence(rng, 30)} {' '.join(passage)} {sentence(rng, 30)}"), (90, f"{sentence(rng, 30)} {' '.join(copy)} {sentence(rng, 30)}")]
    got = {r.doc_id: r for r in passages.repeated_passages(frame(spark, rows)).collect()}
    inside = {k for s in got[90].spans for k in range(s["start"], s["end"])}
    assert inside >= set(range(30, 117)) and len(inside) < 100
    assert not any(got[i].n_dup_words for i in range(len(phrases)))


def test_pages(spark):
    p = '<html><head><title>T</title><style>x{}</style></head><body><nav><a>Home</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p>One <b>two<br>three\n four<p>five &lt;x&gt;<script>var a="</p>";</script><aside>no</aside><form>no</form></article><div id="comments">no</div><footer>&copy;</footer>'
    rows = [(1, "http://a/x", p), (2, None, None), (3, "http://a/y", ""), (4, "bad url", "plain &eacute; text")]
    rows += [(10 + i, f"http://b/{i}", f"<div>All the very same words on each page of the host here</div><div>unique text number {i} of this page alone and nothing else {i * 7} {i * 13}</div>") for i in range(6)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, salt string")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert got[1] == "A & B One two three four five <x>"
    assert (got[2], got[3], got[4]) == ("", "", "plain é text")
    assert got[12] == "unique text number 2 of this page alone and nothing else 14 26"


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(".", " ;")), (2, "words\nReleased under the MIT licence!\nmore"), (3, None), (4, mit + " and more"), (5, "")]
    got = {r.doc_id: (r.license_id, r.n_lines, r.line_licenses) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, 1, "MIT")
    assert got[3] == got[5] == (None, 0, "") and got[4][0] is None
    own = [(1, "Do As You Like"), (2, "first\ndo as you like!"), (3, None)]
    got = {r.doc_id: (r.license_id, r.n_lines, r.line_licenses) for r in licenses.scan(frame(spark, own), (("Free", "Do as you like."),)).collect()}
    assert got == {1: ("Free", 1, "Free"), 2: (None, 1, "Free"), 3: (None, 0, "")}
    assert [r.n_lines for r in licenses.scan(frame(spark, own[:1]), ()).collect()] == [0]


def test_licence_files_as_they_are_distributed(spark):
    import textwrap

    mit, isc = textwrap.fill(licenses.KNOWN[0][1], 78), textwrap.fill(licenses.KNOWN[1][1], 75)
    isc = isc.replace("above copyright", "above\ncopyright").replace("copies. THE", "copies.\n\nTHE")
    bsd = open("/usr/share/common-licenses/BSD").read().replace("the University", "the copyright holder").replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR")
    rows = [("MIT", f"MIT License\n\nCopyright (c) 2020 A Body\n\n{mit}\n"), ("MIT", f"The MIT License (MIT)\nCopyright 2020 A\n{mit}"), ("ISC", f"ISC License\n\nCopyright (c) 2020, A Body\n\n{isc}\n")]
    rows += [("0BSD", f"BSD Zero Clause License\n\nCopyright (c) 2020 A\n\n{textwrap.fill(licenses.KNOWN[2][1], 78)}"), ("Zlib", f"zlib License\n\n(C) 2020 A\n\n{textwrap.fill(licenses.KNOWN[3][1], 78)}"), ("BSD-3-Clause", bsd), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + bsd)]
    rows += [(i, open(f"/usr/share/common-licenses/{n}").read()) for i, n in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"))]
    rows += [(None, "MIT License\n\nCopyright (c) 2020 A Body"), (None, f"MIT License\n{mit} and more")]
    got = {r.doc_id: r.license_id for r in licenses.scan(frame(spark, [(k, t) for k, (_, t) in enumerate(rows)])).collect()}
    assert got == {k: i for k, (i, _) in enumerate(rows)}


def test_bpe_of_texts_without_a_pair_to_merge(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for only in ("a", "7", "~"):
        assert [r.ids for r in bpe.encode_decode(frame(spark, [(1, only)]), path).collect()] == [str(tok.encode(only, add_special_tokens=False).ids[0])]
    rng = random.Random(21)
    odd = ["".join(rng.choice("ab 7~\n\t.,'éß日🎉\u0301\u200d\x00|<>") for _ in range(rng.randint(0, 12))) for _ in range(700)]
    late = ["same text again"] * 250 + ["~"]  # a later slice with one new pre-token
    rows = list(enumerate([*odd, *late]))
    for r in bpe.encode_decode(frame(spark, rows), path).collect():
        ids = tok.encode(rows[r.doc_id][1], add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (",".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)), rows[r.doc_id]


def test_line_dedup_keeps_rows_apart(spark):
    """Rows that share an id, columns of any name, rows without an id, and a very long line."""
    line, other = "this line is the same here", "these words stand nowhere else at all"
    rng = random.Random(22)
    long = sentence(rng, 30_000).split()
    rows = [(1, line, "a"), (2, line, "b"), (2, other, "c"), (2, other, "d"), (None, line, "e"), (3, " ".join(long), "f"), (4, " ".join([*long[:20_000], "new", *long[20_001:]]), "g")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, mark string, _gone int, _doc int, row int, tag int, `a.b` int")
    out = linededup.dedup_lines(df)
    got = {r.mark: r.text for r in out.collect()}
    assert {k: v if len(v) < 99 else len(v.split()) for k, v in got.items()} == {"a": line, "b": "", "c": other, "d": other, "e": line, "f": 30_000, "g": ""}
    assert out.columns == ["doc_id", "text", "mark", "_gone", "_doc", "row", "tag", "a.b", "n_lines", "n_dropped"]


def test_null_and_shared_ids(spark):
    rng = random.Random(23)
    x, y = sentence(rng, 90), sentence(rng, 90)
    rows = [(None, x), (None, x), (5, x), (5, y), (9, y), (None, None), (7, None)]
    near = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in near) == [(-1, 5), (-1, 5), (-1, 7), (5, 5), (5, 5), (7, 7), (9, 5)]
    prints = fingerprints.compare_edited(frame(spark, rows)).collect()
    assert len(prints) == len(rows) and all(r.edited_sha256 and r.fingerprint for r in prints)
    kept = passages.repeated_passages(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_dup_words) for r in kept) == [(-1, 0), (-1, 0), (-1, 0), (5, 0), (5, 0), (7, 0), (9, 90)]
    assert {r.word for r in kept} == {"w"}


def test_large_groups_of_fingerprints_are_dealt_again(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 3)
    pts = sorted({int(b) ^ sum(1 << int(i) for i in rng.choice(63, k, replace=False)) for b in base for k in (0, 1, 2, 3, 5) for _ in range(12)})
    links = simhash.hamming_links(spark.createDataFrame([(p,) for p in pts], "fp long"), 4, most=3).collect()
    u, v = (np.array([pts.index(r[c]) for r in links]) for c in ("u", "v"))
    near = [(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if ((pts[i] ^ pts[j]) & (2**64 - 1)).bit_count() <= 4]
    want = simhash.forest(np.array([i for i, _ in near]), np.array([j for _, j in near]), len(pts))
    assert (simhash.forest(u, v, len(pts)) == want).all()


def test_runs_of_a_host_by_brute_force(spark):
    rng = random.Random(24)
    pages = [[(rng.choice((0, 1, 2)), sentence(rng, rng.randint(1, 15))) for _ in range(rng.randint(0, 6))] for _ in range(40)]
    for p in pages[::3]:
        p.insert(rng.randint(0, len(p)), (1, "these ten words stand on every third page of it"))
    hashes = [htmltext.token_hashes(p)[0] for p in pages]
    at, n = htmltext.HostSuffixes(hashes).shared()
    runs = htmltext.run_hashes(np.concatenate([x for h in hashes for x in (h, np.zeros(1, np.uint64))]))[at]
    count = {}
    for h in hashes:
        for r in {tuple(h[i : i + 8].tolist()) for i in range(len(h) - 7)}:
            count[r] = count.get(r, 0) + 1
    want = sorted((int(htmltext.run_hashes(np.array(r, np.uint64))[0]), c) for r, c in count.items() if c > 1)
    assert sorted(zip(runs.tolist(), n.tolist(), strict=True)) == want and want


def test_boilerplate_inside_and_outside_articles(spark):
    rng = random.Random(25)
    share = "please share this page with all of your many friends today"
    rows = []
    for i in range(12):
        own = sentence(rng, 40)
        rows.append((i, f"http://h/{i}", f"<article><p>{own}</p><p>{share}</p></article><div>About this site and the people who write for it every day</div>", own))
        rows.append((50 + i, f"http://g/{i}", f"<div>{own}</div><div>About this site and the people who write for it every day</div>", own))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    for chars in (htmltext.SLICE, 600):  # the second cuts a host into many slices
        got = {r.page_id: r for r in htmltext.extract(df, chars).collect()}
        assert {i: got[i].text for i, *_ in rows} == {i: own for i, _, _, own in rows}
        assert sum(r.n_runs for r in got.values()) == 36


def test_toxicity_on_rows_without_labels(spark):
    """Held-out accuracy: half of the documents have labels, the others are judged right."""
    rng = random.Random(26)
    rows = []
    for i in range(600):
        t = sentence(rng, 60).split()
        if i % 4 == 0:
            t[rng.randint(0, 59)] = rng.choice(("vilename", "foulword"))
        rows.append((i, " ".join(t)))
    lab = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 600) if i // 4 % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.is_toxic for r in toxicity.toxicity(frame(spark, rows), lab).collect()}
    assert sum(got[i] == (i % 4 == 0) for i in range(600) if i // 4 % 2 == 0) >= 0.98 * 300


def test_isolation_forest_by_path_lengths():
    """Scores from the nodes equal those of a plain walk down every tree, and outliers have the shortest paths."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (300, 4)), [[9, 9, 9, 9]]])
    forest = quality.IsolationForest(x, trees=20, sample=64)

    def path(row):
        total = 0
        for feature, split, left, length in forest.nodes:
            at = 0
            while feature[at] >= 0:
                at = left[at] + (row[feature[at]] >= split[at])
            total += length[at]
        return 2.0 ** (-total / len(forest.nodes) / forest.mean_path(forest.size))

    s = forest.score(x)
    assert s == pytest.approx([path(r) for r in x]) and s.argmax() == 300


def test_empty_tables(spark):
    none, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (packing.pack(none, path), quality.quality_rules(none, labels), linededup.dedup_lines(none), fingerprints.compare_edited(none), toxicity.toxicity(none, labels), simhash.near_duplicates(none), licenses.scan(none), bpe.digests(none, public_tokenizers.path("byte_bpe_50k.json")), passages.repeated_passages(none)):
        assert df.count() == 0
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_rows(spark, docs):
    twice = [*docs[:12], *docs[:12], docs[12]]
    for df, n in ((linededup.dedup_lines(frame(spark, twice)), 25), (fingerprints.compare_edited(frame(spark, twice)), 25), (simhash.near_duplicates(frame(spark, twice)), 25), (passages.repeated_passages(frame(spark, twice)), 25)):
        assert df.count() == n


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and {r.length > 0 for r in rows} == {True}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near copies", "passages", "packing"]


def test_each_pipeline_stage_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(27)
    clean = [sentence(rng, 120) for _ in range(40)]
    passage = sentence(rng, 80)
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0]), (100, sentence(rng, 60)), (101, None), (102, ""), (None, sentence(rng, 30)), (103, f"{sentence(rng, 30)} {passage}"), (104, f"{passage} {sentence(rng, 40)}")]
    rows += [(200 + i, f"{sentence(rng, 40)} vilename {sentence(rng, 40)}") for i in range(20)]
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, _ in rows if i is not None and i != 100], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows)
    stage = dict(corpus_pipeline.STAGES)
    texts_of = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text) if r.text is not None else (r.doc_id, "") for r in df.collect())
    plain = sorted((i if i is not None else -1, t or "") for i, t in rows)
    assert texts_of(stage["toxicity"](spark, docs, str(tmp_path))) == [x for x in plain if x[0] < 200]
    got = texts_of(stage["line dedup"](spark, docs, str(tmp_path)))
    assert got == [x for x in plain if x != (100, clean[0])]
    got = texts_of(stage["near copies"](spark, docs, str(tmp_path)))
    assert got == [x for x in plain if x != (100, clean[0]) and x[0] != 102]
    got = dict(texts_of(stage["passages"](spark, docs, str(tmp_path))))
    assert got[104] == rows[46][1][len(passage) + 1 :] and got[103] == rows[45][1] and (100, "") not in got.items()
    pieces = stage["packing"](spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in pieces) == [i for i, _ in plain]
    for df in (f(spark, docs.limit(0), str(tmp_path)) for f in stage.values()):
        assert df.count() == 0


def test_stages_leave_each_others_tables(spark):
    """A stage's result is read after another stage has run; tables that nothing reads go."""
    import corpus_pipeline
    from tracklight.llm import common

    rng = random.Random(31)
    docs = frame(spark, [(i, sentence(rng, 80)) for i in range(20)] + [(30, None)])
    stage = dict(corpus_pipeline.STAGES)
    a = stage["near copies"](spark, docs, "")
    b = stage["line dedup"](spark, docs, "").where("text is not null").select("text")
    assert a.count() == 21 and b.count() == 20
    held = set(common._tables)
    del a, b
    for _ in range(3):  # the session holds the plans of its last actions
        spark.range(9).groupBy("id").count().collect()
        common.sweep(spark)
    assert held and not held & set(common._tables)


def test_near_copies_in_the_stage(spark):
    """Documents of a shingle similarity of 0.8 or more go, whatever the size of their group; others stay."""
    import corpus_pipeline

    rng = random.Random(32)
    base, rows = [sentence(rng, 150).split() for _ in range(12)], []
    for k, words_ in enumerate(base):
        rows.append((100 * k, " ".join(words_)))
        for j in range(1, 4):
            copy = list(words_)
            copy[40 * j - 10] = "other"
            rows.append((100 * k + j, " ".join(copy)))
        rows.append((100 * k + 50, " ".join(words_[:90] + sentence(rng, 60).split())))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()}
    assert kept == {i for i, _ in rows if i % 100 in (0, 50)}
