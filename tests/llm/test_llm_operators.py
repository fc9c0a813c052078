"""Each operator against a plain version of itself, and on odd tables."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import bpe, components, fingerprint, line_dedup, mixing, ngram_join, pii, sharding, toxicity, urlfilter, vafile

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(text, width=5):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y:
                both = len(sets[x] & sets[y])
                if both and 100 * both >= 80 * len(sets[x] | sets[y]):
                    p, q = find(x), find(y)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited_copies(seed, n, words=60):
    """Texts of many sizes with copies, near copies of near copies, and a shared passage."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 6, 8, 12, 25, words, 4 * words]))]
            if rng.random() < 0.4:
                w += passage.split()
        out.append((i, " ".join(w)))
    return out


# ---- 1


def test_ngram_join_finds_every_component(spark):
    rows = edited_copies(5, 160)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_rows_of_one_id_are_one_node(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue cyan pink grey black")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, b), (11, c), (13, "alone"), (13, None)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(3, 2, 3), (5, 2, 3), (5, 2, 3), (7, 2, 3), (9, 3, 3), (9, 2, 3), (11, 3, 3), (13, 1, 13), (13, 0, 13)])


def test_the_boundary_has_no_limit_but_cost():
    cost = lambda n, length: ((p := n - ngram_join.least_overlap(n) + 1) + 1) * p / 2 <= p * (1 + length)
    for length in (0.0, 0.9, 3.0, 40.0):
        n = ngram_join.boundary(length)
        assert cost(n, length) and not cost(n + 1, length)
    assert ngram_join.boundary(40.0) > 64


def test_ngram_join_on_odd_rows(odd, clashing, none):
    for frame in (odd, clashing):
        rows = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(frame).collect())
        assert rows[2, 16, 1] == 1 and rows[1, 16, 1] == 1 and rows[3, 16, 1] == 1  # 15 of 17 shingles are shared
        assert rows[7, 1, 7] == 2 and rows[4, 0, 4] == rows[5, 0, 5] == rows[6, 0, 6] == 1 and rows[None, 16, None] == 1
    assert ngram_join.join(none).count() == 0


@pytest.mark.parametrize("light_to", [1, 8, 64])
def test_any_boundary_keeps_the_shared_key(light_to):
    rng = np.random.default_rng(light_to)
    classes = rng.integers(0, 3, 1 << ngram_join.SKETCH_BITS).astype(np.uint8)
    for n in range(2, 60):
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        allowed = int(len(base) - -(-80 * len(base) // 100))
        other = np.unique(np.concatenate([base[allowed:], rng.integers(0, 2**63, allowed // 2).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 100 * both >= 80 * (len(base) + len(other) - both) and len(base) != both:
            a, b = (ngram_join.signatures(x, classes, light_to, 80) for x in (base, other))
            assert len(np.intersect1d(a, b)), (n, len(other))


def test_maps_never_differ_more_than_the_sets():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (10, 900), (500, 480), (3000, 2900)):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: m // 2], rng.integers(0, 2**63, m // 2 + 1).astype(np.uint64)]))
        assert ngram_join.bits_apart(ngram_join.parity_map(x), ngram_join.parity_map(y)) <= len(np.setxor1d(x, y))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert {v for k, v in got.items() if k <= 40} == {0} and {v for k, v in got.items() if k >= 100} == {100} and len(got) == 41 + 60
    assert components.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


# ---- 2


def toxic_rows(n=400, seed=2):
    rng = random.Random(seed)
    calm = [f"calm{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(calm) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(30)] = rng.choice(["dolt", "nitwit", "numpty"])
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_and_keeps_held_out_rows_apart(spark):
    rows, labels = toxic_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert {"=dolt", "=nitwit", "=numpty"} <= set(model.lexicon)
    got = {r.doc_id: (r.tox_score, r.tox_predicted) for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i][1] == (i % 5 == 0) and 0 <= got[i][0] <= 1 for i in held)
    flipped = spark.createDataFrame([(i, 1 - t if i in set(held) else t) for i, t in labels], "doc_id long, toxic int")
    again = toxicity.train(docs, flipped)
    assert again.lexicon == model.lexicon and np.allclose(again.weights, model.weights)


def test_toxicity_grammar_tells_directed_negated_and_reported():
    s = toxicity.Scorer({"=dolt": 2.0})
    plain, directed, negated, reported = (s.features(t)[:4] for t in ("what a dolt came", "you are a dolt", "he came. not a dolt", "he said the next dolt came"))
    assert plain[toxicity.PLAIN] > 0 and directed[toxicity.DIRECTED] > 0 and negated[toxicity.NEGATED] > 0 and reported[toxicity.REPORTED] > 0
    assert s.features("not here. dolt")[toxicity.PLAIN] > 0  # a clause ends the negation
    assert s.features("I will hurt you")[4:8] != [0.0] * 4 and s.features("") == [0.0] * s.N


def plain_candidates(text):
    words = {m.lower().replace("’", "'") for m in toxicity.TOKEN.findall(text or "") if m[0].isalpha()}
    return {"=" + w for w in words if len(w) >= 3} | {"^" + w[:n] for w in words for n in range(4, 11) if len(w) >= n}


def plain_lexicon(rows):
    """rows: text, toxic. Every candidate by its counts."""
    n1, n0 = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    hit, every = Counter(), Counter()
    for text, y in rows:
        every.update(plain_candidates(text))
        hit.update(plain_candidates(text) if y else ())
    out, p = {}, n1 / (n1 + n0)
    for c, n in every.items():
        rate = hit[c] / n
        if hit[c] < 4 or rate <= p:
            continue
        bits = n * (rate * math.log(rate / p) + ((1 - rate) * math.log((1 - rate) / (1 - p)) if rate < 1 else 0))
        odds = math.log((hit[c] + 0.5) / (n1 + 1)) - math.log((n - hit[c] + 0.5) / (n0 + 1))
        if bits >= math.log((2e5 + 50 * (n1 + n0)) / 0.05) and odds > 1.5:
            out[c] = odds
    return out


def plain_features(text, lexicon):
    """Clause by clause, looking back from every hit."""
    sums, clause_sums, total_words, met = [0.0] * 8, [], 0, set()
    clause = []
    clauses = [clause]
    for t in toxicity.TOKEN.findall(text or ""):
        if t[0] in ".!?;\n":
            clause = []
            clauses.append(clause)
        else:
            clause.append(t)
    for clause in clauses:
        kinds, weights = [], []
        for t in clause:
            w = t.lower().replace("’", "'")
            weight = max([lexicon.get("=" + w, 0.0)] + [lexicon.get("^" + w[:n], 0.0) for n in range(4, 11) if len(w) >= n])
            kind = "insult" if weight > 0 else "report" if t[0] in '"“”«»' else next((k for k, ws in (("threat", toxicity.THREATS), ("report", toxicity.REPORTS), ("negation", toxicity.NEGATIONS), ("target", toxicity.TARGETS)) if w in ws), "other")
            kinds.append(kind)
            weights.append(weight if kind == "insult" else 1.0)
        total_words += len(clause)
        mine = 0.0
        for i, kind in enumerate(kinds):
            if kind in ("insult", "threat"):
                how = toxicity.NEGATED if "negation" in kinds[max(0, i - 3) : i] else toxicity.REPORTED if "report" in kinds[:i] else toxicity.DIRECTED if "target" in kinds[max(0, i - 4) : i] else toxicity.PLAIN
                sums[how + 4 * (kind == "threat")] += weights[i]
                if kind == "insult":
                    mine += weights[i]
                    met.add(clause[i])
        clause_sums.append(mine)
    if not any(sums):
        return [0.0] * 12
    return [math.log1p(x) for x in sums] + [sum(sums[:4]) / math.sqrt(total_words + 1), math.log1p(sum(x > 0 for x in clause_sums)), math.log1p(max(clause_sums)), math.log1p(len(met))]


def test_the_machine_equals_a_plain_reading_of_clauses():
    rng = random.Random(6)
    lexicon = {"=dolt": 2.0, "^numpt": 1.25, "=kill": 0.5}
    words = ["dolt", "numpty", "Numptish", "kill", "hurt", "you", "not", "said", "plain", "word", "house", "töten", "laut", "nicht"]
    scorer = toxicity.Scorer(lexicon)
    for _ in range(600):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", ". ", "! ", ', "', "\n"]) for _ in range(rng.randint(0, 25)))
        assert np.allclose(scorer.features(text), plain_features(text, lexicon)), text


def test_toxicity_equals_a_plain_version(spark):
    rows, labels = toxic_rows(600, 9)
    rows = [(i, ("You are not " if i % 7 == 0 else "He said ") + t) for i, t in rows] + [(900, None), (901, "")]
    marks = dict(labels)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    known = [(t, marks[i]) for i, t in rows if i in marks and zlib.crc32(str(i).encode()) % 4 != 2]
    assert model.lexicon == pytest.approx(plain_lexicon(known))
    x = np.array([plain_features(t, model.lexicon) + [1.0] for t, _ in known])
    y, penalty = np.array([y for _, y in known], float), np.r_[np.ones(12), 1e-6]
    gradient = x.T @ (1 / (1 + np.exp(-x @ model.weights)) - y) + penalty * model.weights  # the least loss has none
    assert np.abs(gradient).max() < 1e-3
    for r in toxicity.score(docs, model).collect():
        want = 1 / (1 + math.exp(-float(np.array(plain_features(r.text, model.lexicon) + [1.0]) @ model.weights)))
        assert r.tox_score == pytest.approx(want, abs=1e-9) and r.tox_predicted == (want >= toxicity.THRESHOLD)


def test_toxicity_on_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (77, 0)], "doc_id long, toxic int")
    for marks in (labels, labels.where("false"), labels.where("toxic = 1")):
        model = toxicity.train(odd.select("doc_id", "text"), marks)
        out = toxicity.score(odd, model).collect()
        assert len(out) == odd.count() and all(0 <= r.tox_score <= 1 for r in out)
        assert toxicity.score(none, model).count() == 0


# ---- 3


def fill(sizes, weights, share, cap):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, total, out = set(order), share * sum(sizes.values()), {}
    while left:
        level = (total - sum(out.values())) / sum(w[s] for s in left)
        over = [s for s in left if level * w[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in left}
        for s in over:
            out[s] = cap * sizes[s]
            left.discard(s)
    return out


def test_mixing_meets_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["b", "a", "a", "a", "é", None])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = fill(dict(sizes), mixing.WEIGHTS, mixing.SHARE, mixing.CAP), Counter()
    for r in got:
        assert r.mix_source_size == sizes[r.source] and r.mix_target == pytest.approx(want[r.source]) and 0 <= r.mix_copies <= 2 and r.mix_taken == r.mix_copies * r.mix_size
        taken[r.source] += r.mix_taken
    assert all(abs(taken[s] - want[s]) <= 55 for s in want)
    again = {r.doc_id: r.mix_copies for r in mixing.copies(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.mix_copies for r in got}
    assert mixing.mix(docs).count() == sum(r.mix_copies for r in got)


def plain_mix(rows, share=1.5, cap=2.0):
    """rows: doc_id, text, source. Copies of each row, along one prefix sum a source."""
    text_of = lambda t: hashlib.md5(t.encode()).hexdigest() if t is not None else "none"
    by, out = {}, [0] * len(rows)
    for k, (i, t, s) in enumerate(rows):
        size = len(WORD.findall(t or ""))
        drawn = int(hashlib.md5(f"{'' if i is None else i}|{text_of(t)}".encode()).hexdigest()[:12], 16)
        octave = (size + 1).bit_length() - 1
        band = octave * 32 + int((size + 1) * 32 / 2**octave) - 32
        by.setdefault(s, []).append((band if drawn // 2**24 % 2 == 0 else mixing.SLOPES - band, drawn % mixing.SALTS, i is not None, i or 0, text_of(t), size, k))
    sizes = {s: sum(x[5] for x in own) for s, own in by.items()}
    wanted = fill(sizes, mixing.WEIGHTS, share, cap)
    for s, own in by.items():
        name = "1" if s is None else "0" + s
        u = int(hashlib.md5(f"{name}|{mixing.SEED}".encode()).hexdigest()[:10], 16) / 2**40
        rate = min(wanted[s] / sizes[s], cap) if sizes[s] else 0.0
        for n, x in enumerate(sorted(own)):
            out[x[6]] = math.floor((n + 1) * rate + u) - math.floor(n * rate + u)
    return out


def test_mixing_equals_a_plain_version_and_ties_are_told_apart(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 7, 7, i]), rng.choice([None, "", " ".join(["w"] * rng.randint(0, 9)), f"x{i} y"]), rng.choice(["b", "a", "a", "é", None])) for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter(zip(((*r,) for r in rows), plain_mix(rows), strict=True))
    for parts in (1, 5):
        got = Counter(((r.doc_id, r.text, r.source), r.mix_copies) for r in mixing.copies(frame.repartition(parts)).collect())
        assert got == want


def test_mixing_on_odd_rows(odd, clashing, none):
    assert mixing.copies(odd).count() == odd.count()
    assert mixing.mix(clashing).columns == clashing.columns
    assert mixing.copies(none).count() == 0 == mixing.mix(none).count()
    assert {r.mix_taken for r in mixing.copies(odd.where("text IS NULL")).collect()} == {0}


# ---- 4


def brute_lines(rows):
    places = [(i, k, tuple(WORD.findall(line))) for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]) for k, line in enumerate((t or "").split("\n"))]
    first = {}
    for i, k, w in places:
        if w:
            first.setdefault(w, (i, k))
    bad = {x for x in first for y in first if first[y] < first[x] and min(len(x), len(y)) >= line_dedup.MIN_WORDS and line_dedup.edits(list(x), list(y), bound := line_dedup.allowed(min(len(x), len(y)))) <= bound}
    return {v for w, v in first.items() if w not in bad}


def test_line_dedup_keeps_the_earliest(spark):
    rng = random.Random(9)
    base = [[rng.choice("abcde") for _ in range(rng.choice([7, 8, 9, 11, 20]))] for _ in range(25)]
    rows = []
    for i in range(200):
        lines = []
        for _ in range(rng.randint(0, 4)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                p, how = rng.randrange(len(w)), rng.random()
                w = w[:p] + ([rng.choice("abcde")] if how < 0.4 else [rng.choice("abcde"), w[p]] if how < 0.7 else []) + w[p + 1 :]
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    keep = brute_lines(rows)
    for i, t in rows:
        lines = t.split("\n")
        left = [x for k, x in enumerate(lines) if not WORD.search(x) or (i, k) in keep]
        assert got[i].n_kept == sum((i, k) in keep for k in range(len(lines)))
        assert got[i].text == ("\n".join(left) if got[i].n_kept < got[i].n_lines else t)


def test_line_dedup_on_odd_rows(odd, clashing, none):
    for frame in (odd, clashing):
        out = [r for r in line_dedup.dedup(frame).collect()]
        by = {r.doc_id: r for r in out}
        assert len(out) == odd.count() and by[1].n_kept == 1 and by[2].n_kept == 0 and by[2].text == "" and by[3].n_kept == 0 and by[4].text is None
        assert by[8].text == "you idiot\nplain line of eight words stands here now" and by[11].n_kept == 0 and by[None].n_kept == 1
        assert [r.n_kept for r in out if r.doc_id == 7] == [1, 1]
    assert line_dedup.dedup(none).count() == 0


def test_line_dedup_allows_more_edits_in_longer_lines(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([23, 24, 30, 36, 60, 130]))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, len(w) // 8)):
            p, how = rng.randrange(len(w)), rng.random()
            w = w[:p] + ([rng.choice(vocab)] if how < 0.5 else [rng.choice(vocab), w[p]] if how < 0.75 else []) + w[p + 1 :]
        rows.append((i, " ".join(w)))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    got = {r.doc_id: r.n_kept for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = [t.split() for _, t in rows]
    near = [[distance(words[i], words[j]) for j in range(i)] for i in range(len(rows))]
    want = {i: int(not any(d <= max(1, min(len(words[i]), len(words[j])) // 12) for j, d in enumerate(near[i]))) for i in range(len(rows))}
    assert got == want and any(not want[i] and min(near[i]) > 1 for i in want)
    for i in range(40):
        for j in range(i):
            assert line_dedup.edits(words[i], words[j], 9) == min(near[i][j], 10)


def test_line_dedup_pairs_few_lines_that_are_not_alike(spark, monkeypatch):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    plain = [[rng.choice(vocab) for _ in range(rng.choice([26, 30, 37]))] for _ in range(380)]
    near = [[rng.choice(vocab) if k in (3, 20) else w for k, w in enumerate(x)] for x in plain[:20]]
    rows = [(i, " ".join(x)) for i, x in enumerate(plain + near)]
    counts, write = {}, line_dedup.materialise

    def counted(df, label, *more):
        out = write(df, label, *more)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialise", counted)
    got = {r.doc_id for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_kept}
    assert got == set(range(380)) == {i for i, _ in brute_lines(rows)}
    assert counts["lines-near"] == 0  # of lines of two edits or more no variants are made
    assert 20 <= counts["lines-runs"] < 400 and counts["lines-pairs-first"] + counts["lines-pairs-rest"] < 60


def test_alike_lines_share_a_first_run_and_are_told_from_others():
    rng = random.Random(12)
    for per_edit in (4, 7, 12):
        left, right = [], []
        for _ in range(400):
            vocab = [f"é{i}" for i in range(rng.choice([1, 2, 5, 200]))]
            x = [rng.choice(vocab) for _ in range(rng.choice([8, 24, 25, 60, 130, 70 * per_edit]))]
            y = list(x)
            for _ in range(rng.randint(0, len(x) // per_edit + 1)):
                p, how = rng.randrange(len(y)), rng.random()
                y = y[:p] + ([rng.choice(vocab)] if how < 0.5 else [rng.choice(vocab), y[p]] if how < 0.75 else []) + y[p + 1 :]
            left.append(x)
            right.append(y)
        bound = [line_dedup.allowed(min(len(x), len(y)), per_edit) for x, y in zip(left, right, strict=True)]
        want = [line_dedup.edits(x, y, k) <= k for x, y, k in zip(left, right, bound, strict=True)]
        assert line_dedup.alike(*(pa.array(["\t ".join(x) + "\r" for x in side]) for side in (left, right)), per_edit, 8).tolist() == want
        runs = []
        for side in (left, right):
            own = []
            for x in side:
                for _, _, b, offsets, _ in line_dedup.line_slices(pa.array([" ".join(x)])):
                    seq, _, _, s, e = line_dedup.line_words(b, offsets)
                    own.append(set(line_dedup.first_runs(seq, s, e, np.zeros(1 << 20, np.uint8), per_edit)[0].tolist()))
            runs.append(own)
        assert any(want) and all(a & b for a, b, w, k in zip(*runs, want, bound, strict=True) if w and k > 1)


# ---- 5


def test_feistel_is_a_permutation():
    for n in (1, 2, 10, 97, 1000):
        f = pii.Feistel(b"k" * 16, "t", n)
        out = [f.walk(x) for x in range(n)]
        assert sorted(out) == list(range(n)) and [f.walk(y, undo=True) for y in out] == list(range(n))


def test_pseudonyms_keep_format_link_and_undo():
    p = pii.Pseudonyms(b"secret key 12345")
    text = "Card 4111 1111 1111 1111, born 1999-02-28 or 31.12.1999, SSN 123-45-6789, DE89 3704 0044 0532 0130 00, +1 (017) 555-7713, mail ann.b+x9@mail.example.com, host 10.0.0.255, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"; 4111 1111 1111 1112 and 2001-02-30 are none."
    new, spans = p.apply(text)
    assert [k for *_, k in spans] == ["card", "date", "date", "ssn", "iban", "phone", "email", "ip", "secret"]
    assert all(text[s:e] not in new for s, e, _ in spans) and "4111 1111 1111 1112 and 2001-02-30" in new
    card = re.search(r"Card ([\d ]+),", new)[1].replace(" ", "")
    assert pii.luhn_digit(card[:-1]) == card[-1] and re.search(r"born \d{4}-\d\d-\d\d or \d\d\.\d\d\.\d{4}, SSN \d{3}-\d\d-\d{4}", new)
    assert p.apply(new, undo=True)[0] == text
    assert p.apply("4111 1111 1111 1111")[0] in new and pii.Pseudonyms(b"another").apply(text)[0] != new


def test_pseudonyms_beside_other_groups(spark):
    p = pii.Pseudonyms(b"secret key 12345")
    texts = {
        "4111 1111 1111 1111 12/27": "4111 1111 1111 1111", "4111111111111111 123": "4111111111111111", "4111-1111-1111-1111-123": "4111-1111-1111-1111",
        "BE68 5390 0754 7034 USD 500": "BE68 5390 0754 7034", "no 77 4111 1111 1111 1111 12": "4111 1111 1111 1111",
    }
    for text, value in texts.items():
        new, spans = p.apply(text)
        assert [text[s:e] for s, e, _ in spans] == [value] and value not in new and len(new) == len(text)
        assert p.apply(new, undo=True, spans=spans)[0] == text
    odd = "١٢٣-٤٥-٦٧٨٩ and ٤١١١١١١١١١١١١١١١, 4111 1111 1111 1112"
    assert p.apply(odd) == (odd, [])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, odd, None])], "doc_id long, text string")
    hidden = pii.pseudonymise(docs, b"k")
    assert {r.doc_id: r.text for r in pii.pseudonymise(hidden, b"k", undo=True).collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_equal_values_stay_linked_over_their_forms():
    p = pii.Pseudonyms(b"secret key 12345")
    one = lambda t: p.apply(t)[0]
    digits = lambda t: re.sub(r"[^0-9+]", "", t)
    phones = {digits(one(t)) for t in ("+44 20 7946 0958", "+442079460958", "+44-20-7946-0958", "+44 (0)20 7946 0958".replace("(0)", ""))}
    assert len(phones) == 1 and phones.pop().startswith("+44") and "+442079460958" not in one("+442079460958")
    assert digits(one("+44 (0)20 7946 0958"))[:4] == "+440" and digits(one("+44 (0)20 7946 0958"))[4:] == digits(one("+442079460958"))[3:]
    assert digits(one("(555) 123-4567")) == digits(one("+1 555 123 4567"))[2:] == digits(one("555.123.4567"))
    days = {(r[1] or r[6], int(r[2] or r[5]), int(r[3] or r[4])) for r in (re.fullmatch(r"(\d{4})-(\d+)-(\d+)|(\d+)\.(\d+)\.(\d{4})", one(t)) for t in ("1999-02-28", "28.02.1999", "1999-2-28", "28.2.1999"))}
    assert len(days) == 1 and days != {("1999", 2, 28)}
    assert one("05/28/1999").split("/")[::2][0] == f"{next(iter([*p.apply('1999-05-28')[0].split('-')][1:2]))}"  # month first, as no month has 28
    assert one("Ann.B@x.org").lower() == one("ann.b@X.org".replace("X", "x"))


def test_no_value_is_its_own_and_every_letter_changes():
    p = pii.Pseudonyms(b"secret key 12345")
    for local in [*"abcdefghijklmnopqrstuvwxyz0123456789", *(a + b for a in "abc" for b in "xyz019"), "élise.martin", "annélise", "Ünal", "яна", "Ωmega", "张伟", "ß"]:
        text = f"{local}@x.org"
        new, spans = p.apply(text)
        assert new != text and len(new) == len(text) and len(spans) == 1 and p.apply(new, undo=True)[0] == text
        assert [c.isupper() for c in new] == [c.isupper() for c in text]
    changed = {p.apply(f"{a}{b}@x.org")[0] for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"}
    assert len(changed) == 260
    assert all(x != y for x, y in zip("annélise"[3:4], p.apply("annélise@x.org")[0][3:4], strict=True)) or p.apply("annélise@x.org")[0][:8] != "annélise"


def plain_finds(text):
    """Every place from the left, every kind in order, every end from the right; validity told by the definitions."""

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0 and len(set(d)) > 1

    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "card":
            return 13 <= len(d) <= 19 and re.fullmatch(r"[0-9]([ -]?[0-9])*", v) and luhn(d)
        if kind == "iban":
            t = v.replace(" ", "")
            return re.fullmatch(r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?", v) and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1
        if kind == "ssn":
            return re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", v) and v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"
        if kind == "ip":
            return re.fullmatch(r"[0-9]+(\.[0-9]+){3}", v) and all(str(int(x)) == x and int(x) < 256 for x in v.split("."))
        if kind == "date":
            for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"):
                try:
                    return 1900 <= datetime.datetime.strptime(v, form).year <= 2099
                except ValueError:
                    pass
        return False

    out, at = [], 0
    while at < len(text):
        hit = None
        if not (at and re.match(r"[\w.\-/]", text[at - 1])):
            for kind in ("iban", "ip", "date", "ssn", "card"):
                for end in range(min(len(text), at + 42), at, -1):
                    if not re.match(r"[\w\-/]|\.[0-9]", text[end:]) and valid(kind, text[at:end]):
                        hit = (at, end, kind)
                        break
                if hit:
                    break
        if hit:
            out.append(hit)
        at = hit[1] if hit else at + 1
    return out


def test_finds_equal_a_plain_search(spark):
    rng = random.Random(12)

    def card():
        d = "".join(rng.choice("0123456789") for _ in range(15))
        return d + next(c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d + c))) % 10 == 0)

    def piece():
        c = card()
        return rng.choice([c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), c[:-1] + str((int(c[-1]) + 1) % 10), f"{rng.randint(1, 999):03d}-{rng.randint(0, 99):02d}-{rng.randint(0, 9999):04d}", f"{rng.randint(0, 299)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", f"{rng.randint(1890, 2110)}-{rng.randint(1, 13):02d}-{rng.randint(1, 31):02d}", f"{rng.randint(1, 31):02d}.{rng.randint(1, 12):02d}.{rng.randint(1990, 2020)}", "DE89 3704 0044 0532 0130 00", "DE89370400440532013001", "word", "and so", "x9"])

    rows = [(i, ", ".join(piece() for _ in range(rng.randint(0, 6)))) for i in range(200)] + [(200, None), (201, "")]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    met, back = {}, {}
    for i, t in rows:
        spans = [(s.start, s.end, s.kind) for s in out[i].pii_spans]
        assert spans == plain_finds(t or ""), t
        for s, e, kind in spans:
            plain = lambda v: "/".join(sorted(re.split(r"[-.]", v))) if kind == "date" else re.sub("[^A-Z0-9.]", "", v)  # noqa: E731, B023
            old, new = (kind, plain(t[s:e])), (kind, plain(out[i].text[s:e]))
            assert plain_finds(out[i].text[s:e]) == [(0, e - s, kind)] and old != new
            assert met.setdefault(old, new) == new and back.setdefault(new, old) == old
    assert len(met) > 150


def test_pii_on_odd_rows(odd, clashing, none):
    for frame in (odd, clashing):
        out = pii.pseudonymise(frame, b"k").collect()
        assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in odd.collect())  # nothing to hide
    assert pii.pseudonymise(none, b"k").count() == 0


# ---- 6


def brute_top(rows, k, every):
    ok = {i: np.floor(64 * np.array(v, dtype=np.float64)).astype(np.int64) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q in ok:
        if q % every == 0:
            score = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))
            out[q] = [(i, -s) for s, i in score[:k]]
    return out


@pytest.mark.parametrize("dim,scale", [(8, 1.0), (3, 0.02), (5, 1e6)])
def test_top_k_is_exact(spark, dim, scale):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, scale, dim)]) for i in range(400)]
    rows += [(400, None), (401, [None] * dim), (402, [float("nan")] * dim), (403, [float("inf")] + [0.0] * (dim - 1)), (420, [0.5]), (440, [0.25])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in vafile.top_k(frame, frame.where("vec_id % 20 = 0"), k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: v for q, v in brute_top(rows, 7, 20).items() if v}
    assert got == want and got[420] == [(440, got[420][0][1])]


def test_the_file_spares_exact_reads(spark):
    """Clashing columns, copies, and far fewer exact vectors read than the queries have candidates."""
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(0, 0.125, 48)]) for i in range(3000)] + [(5000 + i, [0.5] * 48) for i in range(500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("mine") for c in ("v", "key", "times", "upper", "part", "salt", "query_id", "score", "place")})
    queries = frame.where("vec_id % 20 = 0")
    counts: dict = {}
    got: dict = {}
    for r in vafile.top_k(frame, queries, k=7, counts=counts).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_top([(i, np.float32(v).tolist()) for i, v in rows], 7, 20)
    pairs = len(got) * (len(rows) - 1)
    assert counts["read"] <= counts["candidates"] < pairs / 5 and counts["read"] < pairs / 20
    exact = vafile.usable(frame, "vec_id", "embedding").withColumn("key", F.col("vec_id"))
    block = vafile.approximation_file(exact.coalesce(1)).first()
    assert len(block.cells) == len(block.ids) // 8 * 48 and max(block.cells) < vafile.CELLS  # a byte a component, no exact value


def test_bounds_hold_the_scores():
    rng = np.random.default_rng(1)
    for scale in (3, 300, 10**7):
        v, q = (rng.integers(-scale, scale, (n, 9)) for n in (200, 30))
        lower, upper = vafile.bounds(q, *vafile.approximate(v))
        score = q @ v.T
        assert (lower <= score).all() and (score <= upper).all()


def test_top_k_of_repeated_rows(spark):
    frame = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(40)] * 2, "vec_id long, embedding array<float>")
    out = vafile.top_k(frame, frame.where("vec_id % 20 = 0"), k=5).collect()
    assert Counter(r.query_id for r in out) == {0: 5, 20: 5}
    assert [(r.vec_id, r.score) for r in sorted(out) if r.query_id == 20] == [(2, 64 * 64 * 5), (2, 64 * 64 * 5), (5, 64 * 64 * 5), (5, 64 * 64 * 5), (8, 64 * 64 * 5)]


def test_top_k_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vafile.top_k(frame, frame).count() == 0


# ---- 7


def test_url_filters_judge_by_the_entry_of_the_day(spark):
    listed = urlfilter.entries(spark, [("domain", "bad.test", "block", "2024-01-10"), ("domain", "bad.test", "drop", "2024-02-10"), ("path", "www.bad.test/ok", "allow", "2024-01-01"), ("domain", "x.bad.test", "allow", "2024-01-20"), ("domain", None, "block", "2024-01-01"), ("domain", "late.test", "block", None)])
    caps = [(1, "http://bad.test/", "2024-01-09"), (2, "http://bad.test/", "2024-01-10"), (3, "https://www.BAD.test/ok/page", "2024-01-15"), (4, "https://a.x.bad.test:8080/?q", "2024-01-25"), (5, "https://a.x.bad.test", "2024-01-15"), (6, "http://bad.test/", "2024-02-10"), (7, None, "2024-01-15"), (8, "nonsense", "2024-01-15"), (9, "http://bad.test/", None), (9, "http://notbad.test/", "2024-01-15"), (10, "http://late.test/", "2024-05-05")]
    frame = spark.createDataFrame(caps, "page_id long, url string, d string").withColumn("fetched_on", F.to_date("d")).withColumn("key", F.lit("mine"))
    got = Counter((r.capture, r.verdict) for r in urlfilter.judge(frame, listed).collect())
    assert got == Counter([(1, "none"), (2, "block"), (3, "allow"), (4, "allow"), (5, "block"), (6, "none"), (7, "none"), (8, "none"), (9, "none"), (9, "none"), (10, "none")])
    assert urlfilter.judge(frame.where("false"), listed).count() == 0 and {r.verdict for r in urlfilter.judge(frame, listed.where("false")).collect()} == {"none"}


# ---- 8


def test_differencing_balances_and_is_a_bijection():
    rng = np.random.default_rng(4)
    vectors = rng.integers(0, 1000, (37, 5))
    to = sharding.difference(vectors)
    assert all(sorted(row) == list(range(5)) for row in to)
    sums = np.zeros(5, int)
    for v, t in zip(vectors, to, strict=True):
        np.add.at(sums, t, v)
    assert sums.max() - sums.min() < 120 and sorted(sharding.difference(vectors[:1])[0]) == list(range(5))


def plain_differencing(sizes, k):
    """Lists all partial partitions and takes the two of largest spread."""
    open_ = [(i, [(s, [i])] + [(0, [])] * (k - 1)) for i, s in enumerate(sizes)]
    at = len(open_)
    while len(open_) > 1:
        open_.sort(key=lambda x: (-(x[1][0][0] - x[1][-1][0]), x[0]))
        (_, a), (_, b), *rest = open_
        both = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda x: -x[0])
        open_ = [*rest, (at, both)]
        at += 1
    return sorted((s for s, _ in open_[0][1]), reverse=True)


def test_sharding_equals_plain_differencing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["same", None, "x" * rng.randint(1, 900) + str(i)])) for i in range(700)]
    out = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=7).collect()
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    got = Counter()
    for r in out:
        got[r.shard] += r.size
    assert sorted(got.values(), reverse=True) == plain_differencing(sorted(groups.values(), reverse=True), 7)


def test_sharding_over_several_levels(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(1, 900) + str(i % 1500)) for i in range(2000)]
    out = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=5, groups_per_bucket=40, fan=4).collect()
    got, where = Counter(), {}
    for r in out:
        got[r.shard] += r.size
        where.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert sum(got.values()) == sum(len(t) + 8 for _, t in rows) and max(got.values()) - min(got.values()) < 100 and all(len(x) == 1 for x in where.values())
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(5) for k in range(sum(r.shard == s for r in out))]


def test_sharding(spark, odd, clashing, none):
    rng = random.Random(0)
    rows = [(i, rng.choice(["same", "x" * rng.randint(1, 400), None])) for i in range(3000)]
    out = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = Counter()
    where: dict = {}
    slots: dict = {}
    for r in out:
        t = rows[r.doc_id][1] or ""
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode())
        where.setdefault(t, set()).add(r.shard)
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(x) == 1 for x in where.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    free = [size[s] for s in range(24) if s not in where["same"] and s not in where[""]]  # the two large groups fill shards of their own
    assert max(free) - min(free) < 500
    for frame in (odd, clashing):
        assert sharding.shards(frame).count() == odd.count()
    assert sharding.shards(none).count() == 0


# ---- 9


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def test_bpe_equals_the_library(vocabulary):
    import tiktoken

    path, pattern = vocabulary
    c = bpe.codec(path, pattern)
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(7)
    letters = list("abcde  \n\t\r\x1c\x85\xa0　᠎ 1٣²Ⅷéß'sS't!?.,—漢字🙂́\x00﻿<|endoftext|>")
    for text in ["", "a", "aaaa" * 3000, "xyzé" * 2000, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(3000))]:
        ids = lib.encode_ordinary(text)
        assert c.encode(text) == ids and c.decode(ids) == text.encode() and c.digest(text) == (len(ids), ",".join(map(str, ids)), text.encode())


def test_bpe_on_odd_rows(vocabulary, odd, clashing, none):
    out = bpe.digests(odd, *vocabulary).collect()
    texts = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in out) == texts
    coded = bpe.encode(clashing, *vocabulary)
    assert all(len(r.token_ids) == r.n_tokens for r in coded.collect()) and bpe.digests(none, *vocabulary).count() == 0 == bpe.encode(none, *vocabulary).count()
    assert {bytes(r.decoded) == (r.text or "").encode() for r in bpe.decode(coded, *vocabulary).collect()} == {True}


# ---- 10


def test_fingerprints_estimate_containment_and_edit_right(spark):
    rng = random.Random(3)
    rows = [(3 * i, " ".join(rng.choice(["ab", "cdé", "f", "🙂g"]) + str(rng.randrange(500)) for _ in range(rng.randint(0, 300)))) for i in range(60)]
    out = {r.doc_id: r for r in fingerprint.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(rows):
        q = len(t) // 4
        text = t[: len(t) - q] + rows[(k + 1) % len(rows)][1][:q]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
    long = [out[i] for i, t in rows if len(t.split()) > 80]
    assert all(r.near_edited > 0.45 and r.near_next < 0.15 for r in long) and abs(sum(r.near_edited for r in long) / len(long) - 0.75) < 0.1


def plain_fingerprint(text):
    def hashed(words):
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w.encode(), seed)
        return seed >> 33

    w = WORD.findall(text or "")
    runs = [w[i : i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [w] if w else []
    hashes = sorted({hashed(r) for r in runs})
    return [h for h in hashes if h < fingerprint.FRACTION * 2**31] or hashes[:1]


def plain_likeness(a, b):
    return 1.0 if a == b else len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0


def test_fingerprints_equal_a_plain_version(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["ab", "cdé", "🙂g"]) + str(rng.randrange(9)) for _ in range(rng.choice([0, 1, 2, 3, 4, 7, 40, 200]))) for _ in range(120)]
    texts += ["one two three", "one two three", "", None, "", " \n", "a b", "a b", texts[3], texts[3] + " more"]
    ids = [i * i * 1_000_003 if i % 3 else -i for i in range(len(texts))]  # sparse and of both signs
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.edited(frame).collect()}
    order = sorted(zip(ids, texts, strict=True))
    shown = lambda f: "".join(f"{h:08X}" for h in f)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        changed = t[: len(t) - q] + after[:q]
        own, edited, following = plain_fingerprint(t), plain_fingerprint(changed), plain_fingerprint(after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), shown(own), shown(edited))
        assert r.near_edited == pytest.approx(plain_likeness(own, edited)) and r.near_next == pytest.approx(plain_likeness(own, following))
        assert (r.fingerprint == "") == (not WORD.search(t))


def test_copies_next_to_each_other_are_alike(spark):
    rows = [(1, "one two three"), (2, "one two three"), (3, ""), (4, ""), (5, "x y z"), (6, "x y w")]
    got = {r.doc_id: (r.near_edited, r.near_next) for r in fingerprint.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][1] == 1.0 and got[3] == (1.0, 1.0) and got[2][1] == 0.0 and got[5][1] == 0.0
    two = spark.createDataFrame([("p q r s t u", "a b")], "x string, y string")
    for name in "xy":
        two = fingerprint.add_sketch(two, F.col(name), f"s{name}")
    merged = two.select(fingerprint.merge(F.col("sx"), F.col("sy")).alias("m"), "sx", "sy").first()
    assert merged.m == sorted(v for v in set(merged.sx + merged.sy) if v < fingerprint.FRACTION * 2**31) or merged.m == [min(merged.sx + merged.sy)]


def test_fingerprints_on_odd_rows(odd, clashing, none, spark):
    for frame in (odd, clashing):
        out = fingerprint.edited(frame).collect()
        assert len(out) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
        prints = {}
        for r in fingerprint.fingerprints(frame).collect():
            prints.setdefault(r.text, set()).add(r.fingerprint)
        assert all(len(x) == 1 for x in prints.values()) and prints[""] == {""}
    assert fingerprint.edited(none).count() == 0
    one = fingerprint.edited(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


@pytest.mark.parametrize("share", [0.1, 0.4, 0.5, 0.7])
def test_toxicity_at_any_share_of_labels(spark, share):
    rng = random.Random(5)
    plain = [f"calm{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = [(i, " ".join(rng.choices(plain, k=20) + (["zorgle", "blickfang"] if i % 10 < share * 10 else [])), int(i % 10 < share * 10)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert any("zorgle" in k for k in model.lexicon)
    got = {r.doc_id: r.tox_predicted for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    assert got == {i: y for i, _, y in rows}


def test_blocks_of_the_same_queries_share_a_floor(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(1_200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vafile.usable(frame.where("vec_id % 20 = 0"), "vec_id", "embedding")
    exact = vafile.usable(frame, "vec_id", "embedding").withColumn("key", F.col("vec_id"))
    monkeypatch.setattr(vafile, "TASKS", 1)
    found = vafile.candidates(vafile.approximation_file(exact.repartition(30)), asked, 5)
    per_query = found.groupBy("query_id").count().agg(F.avg("count")).first()[0]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    v = np.array([[math.floor(64 * x) for x in r[1]] for r in rows])
    want = {(q, int(b)) for q in range(0, 1_200, 20) for b in np.argsort([-(v[q] @ x) if i != q else 1 << 40 for i, x in enumerate(v)], kind="stable")[:5]}
    assert want <= {(r.query_id, r.key) for r in found.collect()} and per_query < 40  # 30 blocks of a floor each left 150 at least


def written_by(run):
    """The labels of the tables that are still there after run()."""
    from tidewright import session

    before = set(session._written)
    run()
    return sorted(re.sub("-[0-9a-f]{32}$", "", p.rsplit("/", 1)[1]) for p in set(session._written) - before)


def test_line_dedup_and_ngram_join_leave_only_what_their_results_read(odd):
    assert written_by(lambda: line_dedup.dedup(odd).count()) == ["lines-gone-all", "lines-places"]
    assert written_by(lambda: ngram_join.join(odd).count()) == ["ngram-digests", "ngram-known"]
