"""Components, SimHash, fuzzy lines and repeated strings, against brute force."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from raresift.llm import components, covering_simhash, fuzzy_lines, prefix_free
from raresift.session import shared_dir

SF = "/root/testdata/sf0.001"


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_equal_union_find(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5)]
    links += [(500, 501 + i) for i in range(80)]  # a hub
    want = union(600, links)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want[x] for a, b in links for x in (a, b) if a != b}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_pair_within_the_radius_meets_under_some_mask():
    masks, rnd = covering_simhash.covering_masks(3), random.Random(1)
    assert len(masks) == 15 and all(24 <= m.bit_count() <= 40 for m in masks)
    for _ in range(20_000):
        change = sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3)))
        assert any(not change & m for m in masks)


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    near = [(10_000 + i, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 20 + f"end{i % 7}") for i in range(30)]
    docs = docs.unionByName(spark.createDataFrame(near, docs.schema)).unionByName(
        awkward.where("doc_id is not null").select((F.col("doc_id") + 20_000).alias("doc_id"), "text").distinct()
    )
    rows = docs.collect()
    prints = [plain_print(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots, least = union(len(rows), links), {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    want = {r.doc_id: (f"{p:016x}", least[root]) for r, p, root in zip(rows, prints, roots, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in covering_simhash.simhash_components(docs).collect()}
    assert got == want


def test_simhash_of_awkward_rows(awkward, no_rows):
    rows = covering_simhash.simhash_components(awkward).collect()
    assert len(rows) == awkward.count()
    blank = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert blank == {2}  # NULL, empty and blank texts; the NULL id takes the name of its group
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert [r.component_id for r in rows if r.doc_id is None and r.fingerprint != "0" * 16] == [None]
    assert covering_simhash.simhash_components(no_rows).count() == 0


def plain_character_links(lines, k=5):
    """Pairs of lines of which 0.8 of the ``k``-character runs are common."""
    sets = [frozenset(x[i:i + k] for i in range(max(1, len(x) - k + 1))) for x in lines]
    holders, links = {}, []
    for i, own in enumerate(sets):
        met = Counter(j for s in own for j in holders.get(s, ()))
        links += [(i, j) for j, common in met.items() if common >= 0.8 * (len(own) + len(sets[j]) - common)]
        for s in own:
            holders.setdefault(s, []).append(i)
    return links


def plain_lines(rows):
    """(doc_id, line) of the lines that go, every pair of lines compared."""
    places = {}
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if re.search(r"\S", line):
                places.setdefault(line, []).append((doc, k))
    lines, groups = list(places), {}
    for i, root in enumerate(union(len(lines), plain_character_links(lines))):
        groups.setdefault(root, []).extend(places[lines[i]])
    return {p for g in groups.values() for p in sorted(g)[1:]}


def test_line_removal_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    base = [rnd.choice(words) for _ in range(45)]
    near = [(90_000 + i, " ".join(base[:i % 40] + [f"edit{i}"] + base[i % 40 + 1:]) + "\n\nshort\n") for i in range(60)]
    docs = docs.unionByName(spark.createDataFrame(near, docs.schema))
    want = plain_lines([(r.doc_id, r.text) for r in docs.collect()])
    got = {(r.doc_id, r.line_no) for r in fuzzy_lines.copied_lines(docs).collect()}
    assert got <= want and len(want - got) <= 0.01 * len(want)
    cut = {r.doc_id: r.text for r in fuzzy_lines.without_copied_lines(docs).collect()}
    for r in docs.collect():
        assert cut[r.doc_id] == "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, k) not in got)


def test_line_report_equals_brute_force_on_all_characters(spark):
    rnd = random.Random(12)
    word = lambda low, high, of="abcdefghijklmnop": "".join(rnd.choice(of) for _ in range(rnd.randint(low, high)))

    def edited(line):
        at = rnd.randrange(len(line))
        return line[:at] + "§" + line[at + 1:]

    han = "".join(map(chr, range(0x4E00, 0x4F00))) + "".join(map(chr, range(0x20000, 0x20020)))
    lines = []
    for _ in range(60):
        lines += [(x := word(60, 120, han)), edited(x)]  # no blanks
        lines += [(x := "https://" + word(70, 90)), edited(x)]
        lines += [(x := " ".join(word(6, 9) for _ in range(3))), x + "s"]  # three words
        lines += [(x := word(10, 16) + ": "), *(x + str(n) for n in rnd.sample(range(10), 2))]  # one digit
        lines += [(x := " ".join(word(3, 7) for _ in range(25))), edited(x)]
    lines += ["=" * 20, "=" * 30, "ab", "abc", "abcd", "abcde", "ab", "😀" * 5, "😀" * 9]
    docs = [(k, x) for k, x in enumerate(lines)]
    got = {r.doc_id: r.removed for r in fuzzy_lines.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    distinct = list(dict.fromkeys(lines))
    roots = union(len(distinct), plain_character_links(distinct))
    first = {}
    for k, x in docs:
        first.setdefault(roots[distinct.index(x)], k)
    want = {k: f"0:{f}:0" if (f := first[roots[distinct.index(x)]]) != k else "" for k, x in docs}
    wrong = [k for k in want if got[k] != want[k]]
    assert all(not got[k] or want[k] for k in wrong) and len(wrong) <= 0.02 * sum(map(bool, want.values()))
    assert all(got[len(lines) - 9 + k] == want[len(lines) - 9 + k] for k in range(9))  # equal sets always meet


def test_lines_of_awkward_rows(awkward, no_rows):
    cut = fuzzy_lines.without_copied_lines(awkward, count_col="n_chars")
    assert cut.schema.names == awkward.schema.names and cut.count() == awkward.count()
    rows = {r.doc_id: r for r in cut.where("doc_id > 1").collect()}
    assert rows[2].text is None and rows[3].text == "" and rows[4].text == " \n\t " and rows[6].text == "" and rows[6].n_chars == 0
    assert len(rows[5].text) > 100_000
    assert {r.text for r in cut.where("doc_id = 1").collect()} == {"The quick brown fox. password=abcdefghij123456"}
    report = fuzzy_lines.line_report(awkward)
    assert report.count() == awkward.count() and report.where("n_removed = 1").count() == 1
    assert fuzzy_lines.line_report(no_rows).count() == 0


def test_line_removal_runs_no_python(awkward):
    plan = fuzzy_lines.line_report(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_repeats(rows, span=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - span + 1):
            if data[s:s + span] in seen:
                gone[s:s + span] = b"\1" * span
            seen.add(data[s:s + span])
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[doc] = (len(data), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest())
    return out


@pytest.fixture(scope="module")
def repetitive(spark):
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefgh é\n") for _ in range(700))
    rows = [(0, "a" * 500), (1, "ab" * 400), (2, None), (3, ""), (4, "x" * 99), (5, "x" * 100), (6, "x" * 101), (7, passage)]
    for i in range(8, 60):
        at, size = rnd.randrange(600), rnd.randrange(300)
        noise = "".join(rnd.choice("klmnop ") for _ in range(rnd.randrange(250)))
        rows.append((i, noise[:100] + passage[at:at + size] + noise[100:] + passage[:rnd.randrange(140)]))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block", [1 << 20, 37])
def test_repeats_equal_brute_force(repetitive, monkeypatch, block):
    monkeypatch.setattr(prefix_free, "_BLOCK", block)  # short blocks: a text is parsed in many overlapping parts
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in prefix_free.repeat_report(repetitive).collect()}
    assert got == plain_repeats([(r.doc_id, r.text) for r in repetitive.collect()])


def test_repeats_of_awkward_rows(awkward, no_rows):
    rows = prefix_free.repeat_report(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[2].n_bytes == by_id[3].n_bytes == 0 and by_id[6].n_removed == by_id[6].n_bytes and by_id[8].n_removed == 99_999
    assert by_id[5].n_removed > 400_000 and by_id[7].n_removed > 0
    assert prefix_free.repeat_report(no_rows).count() == 0


@pytest.mark.parametrize("share", [None, 7])
def test_repeats_of_many_texts_under_one_id(spark, share):
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(400))
    texts = ["".join(rnd.choice("klmnop ") for _ in range(rnd.randrange(60, 200))) + passage[(k := rnd.randrange(250)):k + 150] for _ in range(3000)]
    rows = sorted((prefix_free._tag(t.encode()), t) for t in dict.fromkeys(texts))  # rows of one id follow their hash
    want = sorted(plain_repeats(rows).values())
    docs = spark.createDataFrame([(share, t) for _, t in rows], "doc_id long, text string")
    got = prefix_free.repeat_report(docs).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_equal_windows_have_equal_triggers():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    data[2000:2400] = data[500:900]
    triggers, first, last = prefix_free.phrases(data, np.arange(2901), 100)
    of = {s: t - s for t, f, e in zip(triggers, first, last) for s in range(f, e + 1)}
    assert all(of[500 + k] == of[2000 + k] for k in range(301)) and set(of) == set(range(2901))
    assert all(10 <= d <= 74 for d in of.values())


def test_both_ways_of_comparing_phrases_agree(repetitive):
    texts = prefix_free._packed_texts(repetitive)

    def gone(together):
        rows = prefix_free.repeated_phrases(repetitive, texts, together=together).collect()
        places = {(r.doc_id, r.place) for r in rows}
        return {
            (doc, start) for doc, p in places
            for start in range((p >> 16 & 0xFFFFFFFF) - (p >> 8 & 0xFF), (p >> 16 & 0xFFFFFFFF) - (p & 0xFF) + 1)
        }

    assert gone(1024) == gone(0)  # 0: every key is too large for one task


def test_few_pairs_of_a_large_group_are_compared_and_no_link_is_lost(spark, monkeypatch):
    """800 lines, each further from the common original than near copies are, and one family of near copies among them."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(40)]

    def edited(words, n):
        at = set(rnd.sample(range(len(words)), n))
        return [word() if k in at else w for k, w in enumerate(words)]

    family = edited(base, 5)
    lines = [" ".join(base)] + [" ".join(edited(base, 4)) for _ in range(800)] + [" ".join(edited(family, 1)) for _ in range(30)]
    tried, verified = [], fuzzy_lines._verified

    def counted(pairs, *more):
        tried.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(fuzzy_lines, "_verified", counted)
    docs = [(k, x) for k, x in enumerate([*lines, *[lines[0]] * 5])]
    gone = {r.doc_id for r in fuzzy_lines.copied_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {doc for doc, _ in plain_lines(docs)}
    assert gone <= want and len(want - gone) <= 0.01 * len(want)
    assert sum(tried) < 20 * len(lines)  # all pairs: 344,865


def test_line_removal_keeps_no_step_on_disk(spark):
    """Each step is deleted when no later one reads it; the rule of what goes is all that the result needs."""
    folder = Path(re.sub("^file:", "", shared_dir(spark)))
    steps = lambda: {p.name for p in folder.iterdir() if p.name.startswith("raresift")}
    before = steps()
    lines = [f"{w} fox jumps over the lazy dog number {n} of the whole field" for n in range(12) for w in ("quick", "quicker")]
    gone = fuzzy_lines.copied_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert len(steps() - before) == 1 and gone.count() > 0
