"""Conversation trie, phrases and language-model scores against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from raresift.llm import conversation_trie, phrase_mining, ppm_scores

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """conv_id, depth, parent, members, children, leaves, saved, digest of every node, by nested loops."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(rows)] for c, rows in turns.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(own) - 1) * words
    return {
        (own[0], len(path), members[path[:-1]][0] if path else None, len(own), len(children[path]), leaves[path], saved[path],
         hashlib.sha256(",".join(str(c) for c in own if rebuilt[c] == path).encode()).hexdigest())
        for path, own in members.items()
    }


def test_conversation_trie_equals_brute_force(spark):
    rng, rows = random.Random(4), []
    for conv in range(90):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["yes", "yes", "no  and\tmore", "", None, "Ünï   x"])))
    rows += [(200, t, "user", f"turn {t}") for t in range(400)] + [(220, None, "user", "first"), (220, 0, "user", "second"), (-7, 1, "user", "yes")]
    rows += [(None, 1, "user", "no conversation"), (3, 9, "user", "again"), (3, 9, "user", "again"), (41, 9, None, None)]
    found = conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in found} == plain_trie(rows) and len(found) == len({tuple(r) for r in found})


def test_conversation_trie_of_awkward_tables(spark, awkward, no_rows):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert conversation_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    clashing = [(c, t, "user", "same") for c in range(1, 400) for t in range(3)]
    table = spark.createDataFrame(clashing, SCHEMA).selectExpr("*", *[f"'taken' AS `{c}`" for c in ("depth", "NODE", "one", "arc", "place", "size")])
    assert {tuple(r) for r in conversation_trie.prefix_trie(table).collect()} == plain_trie(clashing)


def test_lists_are_ranked_over_many_blocks(spark):
    order = list(range(2, 3002))
    random.Random(1).shuffle(order)
    arcs = spark.createDataFrame(list(zip(order, [*order[1:], None], strict=True)), "arc long, next long")
    for block in (7, 1000, 1 << 20):
        steps = {r.arc: r.steps for r in conversation_trie.list_rank(arcs, block=block).collect()}
        assert steps == {arc: len(order) - k for k, arc in enumerate(order)}


def plain_collocations(rows, least, top):
    """lang -> ranked (phrase, a, l, r, n, score), every phrase counted in a dictionary."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals, out = defaultdict(Counter), Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(fold)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[k:k + size]) for k in range(len(words) - size + 1))
    for lang, f in counts.items():
        found = []
        often = [p for p, a in f.items() if a >= least and len(p) > 1]
        for p in often:
            inside = any(
                len(q) > len(p) and 100 * f[q] >= 80 * f[p] and any(q[k:k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q in often
            )
            if not inside:
                score, cut = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -f[p], " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out[lang] = [(p.decode(), -a, l, r, totals[lang], -s) for s, a, p, l, r in sorted(found)[:top]]
    return {lang: found for lang, found in out.items() if found}


def ranked(found):
    out = defaultdict(list)
    for row in sorted(found.collect(), key=lambda r: (r.lang, r.rank)):
        assert row["rank"] == len(out[row.lang]) + 1
        out[row.lang].append((row.phrase, row.a, row.l, row.r, row.n, row.score))
    return dict(out)


def test_collocations_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["the", "The", "of", "Éa", "x", "naïve", "new\tyork", "a", "b", "c", "\x00", "\u00a0", "q" * 300]
    texts = ["".join(rng.choice(vocabulary) + rng.choice("    .,\n\t") for _ in range(rng.randrange(0, 120))) for _ in range(300)]
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in texts] + [("fr", "so very " * 3000), ("fr", None), (None, ""), ("en", "New York is new york " * 40)]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string")
    assert ranked(phrase_mining.collocations(table, least=7, top=40)) == plain_collocations(rows, 7, 40)
    # Texts in many slices and chunks, cut inside pieces; the dictionary begun anew. (The small texts are one partition here.)
    many = table.coalesce(1)
    chunks = list(phrase_mining.suffix_chunks(iter([(r.lang or "und", (r.text or "").encode()) for r in many.collect()]), 4))
    monkeypatch.setattr(phrase_mining, "_SLICE", 50), monkeypatch.setattr(phrase_mining, "_CHUNK", 200), monkeypatch.setattr(phrase_mining, "_WORDS", 5)
    small = list(phrase_mining.suffix_chunks(iter([(r.lang or "und", (r.text or "").encode()) for r in many.collect()]), 4))
    assert len(small) > 50 > len(chunks)

    def counted(parts):
        out = Counter()
        for part in parts:
            for row, weight in zip(part.keys.tolist(), part.weights.tolist(), strict=True):
                out[part.lang, tuple(part.words[k] if k else b"" for k in row)] += weight
        return out

    assert counted(small) == counted(chunks)


def test_collocations_of_awkward_tables(awkward, no_rows):
    assert phrase_mining.collocations(no_rows).collect() == []
    rows = [(r.lang, r.text) for r in awkward.select("lang", "text").collect()]
    assert ranked(phrase_mining.collocations(awkward)) == plain_collocations(rows, 30, 2000)


def test_multikey_quicksort_counts_prefixes():
    rng = np.random.default_rng(2)
    keys = rng.zipf(1.6, (5000, 4)).clip(0, 40) - 1
    for k in range(1, 4):
        keys[:, k] *= keys[:, k - 1] > 0
    weights, expected = rng.integers(1, 4, 5000), Counter()
    for row, weight in zip(keys.tolist(), weights.tolist(), strict=True):
        for size in range(1, 5):
            if row[size - 1]:
                expected[tuple(row[:size])] += weight
    for least, whole in ((1, 1), (30, 1), (30, 3)):
        found = {}
        for pointers, size, counts in phrase_mining.frequent_prefixes(keys, weights, least, whole):
            found |= dict(zip(map(tuple, keys[pointers, :size].tolist()), counts.tolist(), strict=True))
        assert found == {p: a for p, a in expected.items() if a >= least or len(p) < whole}


def plain_ppm(trained, text, order=5):
    """log10 probability of a text, symbol by symbol, with an explicit set of excluded symbols."""
    seen, known = [defaultdict(Counter) for _ in range(order + 1)], [set() for _ in range(order + 1)]
    for own in trained:
        data = b"\n" * order + own + b"\n"
        for at in range(order, len(data)):
            seen[order][data[at - order:at]][data[at]] += 1
            known[order].add((data[at - order:at], data[at]))
    for k in range(order - 1, -1, -1):
        for context, symbol in known[k + 1]:
            seen[k][context[1:]][symbol] += 1
            known[k].add((context[1:], symbol))
    data, total = b"\n" * order + text + b"\n", 0.0
    for at in range(order, len(data)):
        excluded = set()
        for k in range(order, -1, -1):
            left = {s: n for s, n in seen[k][data[at - k:at]].items() if s not in excluded}
            if data[at] in left:
                total += math.log10((left[data[at]] - 0.3) / sum(left.values()))
                break
            if left:
                total += math.log10(0.3 * len(left) / sum(left.values()))
            excluded |= set(left)
        else:
            total -= math.log10(256 - len(excluded))
    return total


def plain_scores(rows):
    """held_out, n_tokens, n_known, train_tokens, base_score, score of every (doc_id, text)."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)) for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    counts = Counter(w for own, out in zip(words, held, strict=True) if not out for w in [*own, None])
    total, trained = sum(counts.values()), [" ".join(own).encode() for own, out in zip(words, held, strict=True) if not out]
    scores = {}
    for (doc, _), own, out in zip(rows, words, held, strict=True):
        tokens, text = [*own, None], " ".join(own).encode()
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in tokens)
        if text not in scores:
            scores[text] = plain_ppm(trained, text)
        yield doc, out, len(tokens), sum(w in counts for w in tokens), total, base, scores[text]


def same_scores(found, expected):
    found = sorted((tuple(r) for r in found), key=lambda r: (r[0] is not None, *map(str, r[:5]), r[5]))
    expected = sorted(expected, key=lambda r: (r[0] is not None, *map(str, r[:5]), r[5]))
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in expected], rtol=1e-9, atol=1e-9)


def test_ppm_scores_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["the", "The", "then", "theme", "Éa", "a", "b", "naïve", "\x00", " x", "rare"]
    rows = [(k, rng.choice(["\t", " ", "\n "]).join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for k in range(60)]
    rows += [(None, "the the"), (None, None), (7, None), (8, ""), (9, rows[0][1]), (9, rows[0][1]), (11, "unheard of"), (59, "zebra crossing")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ppm_scores, "_PART", 40)
    same_scores(ppm_scores.ppm_scores(table, held_out=F.expr("crc32(CAST(doc_id AS STRING)) % 10 = 0"), block_bytes=700).collect(), list(plain_scores(rows)))
    monkeypatch.undo()
    same_scores(ppm_scores.score_report(table.withColumns({c: F.lit("taken") for c in ("one", "LEARN", "held_out", "packed", "block")})).collect(), list(plain_scores(rows)))


def test_ppm_probabilities_sum_to_one():
    rng = np.random.default_rng(6)
    trained = rng.integers(97, 101, 4000).astype(np.uint8).tobytes()
    runs, counts = ppm_scores.summed(*(np.concatenate(x) for x in zip(*[(r, np.ones(len(r), np.int64)) for _, r in ppm_scores.runs_of([(0, trained)])], strict=True)))
    low = np.zeros((256, 256), np.int64)
    for three in {run & 0xFFFFFF for run in runs.tolist()}:
        low[three >> 8 & 255, three & 255] += 1
    contexts = [runs[0] >> 8, runs[500] >> 8, int.from_bytes(b"abczz"), int.from_bytes(b"zzzab"), int.from_bytes(b"zzzzz")]
    asked = np.array([c << 8 | s for c in contexts for s in range(256)])
    every, sums = ppm_scores.summed(np.concatenate([runs, asked]), np.concatenate([counts, np.zeros(len(asked), np.int64)]))
    found = ppm_scores.log_probabilities(every, sums, low)
    for context in contexts:
        mine = found[np.isin(every, [context << 8 | s for s in range(256)])]
        assert len(mine) == 256 and abs((10**mine).sum() - 1) < 1e-9


def test_ppm_scores_of_awkward_tables(spark, awkward, no_rows):
    assert ppm_scores.score_report(no_rows).collect() == []
    short = awkward.where(F.coalesce(F.length("text"), F.lit(0)) < 1000)
    same_scores(ppm_scores.score_report(short).collect(), list(plain_scores([(r.doc_id, r.text) for r in short.collect()])))
    found = ppm_scores.score_report(awkward).collect()
    assert len(found) == awkward.count() and {r.score for r in found if r.doc_id == 5} == {r.score for r in found if r.doc_id == 6}
    nothing = ppm_scores.ppm_scores(awkward.where("doc_id < 5"), held_out=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in nothing)
    assert {round(r.score / math.log10(1 / 256)) for r in nothing if r.doc_id == 1} == {len("the quick brown fox. password=abcdefghij123456") + 1}


def test_model_beats_word_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = ppm_scores.score_report(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]
