"""Toxicity by a weighted finite-state pattern grammar over clauses.

Transducers, each a table (state, symbol) -> (state, symbol), composed into one:
  lexicon   words to symbols: insult, threat, target, negation, report, other. Targets, negations, reports and threats
            are fixed words; insults are learned: whole words and word beginnings, each with a weight.
  negation  an insult or threat up to NEGATION_SCOPE words after a negation becomes a negated one.
  report    an insult or threat after a report word or a quotation mark in its clause becomes a reported one.
  target    an insult or threat up to TARGET_SCOPE words after a target becomes a directed one.
A clause (up to . ! ? ; or a line end) is matched as a whole: each insult or threat leaves the composed machine under one
output (plain, directed, negated, reported), and the weights are summed by output. The score is a logistic function of the
document's sums, their density and the clauses that matched.

Training: at most TRAIN_ROWS labelled rows (those with the least xxhash64 of doc_id, so the same rows on every run), never
rows that are held out. Insult weights are log odds; a word or beginning enters if a Chernoff bound on its count in toxic
rows is significant after correction for all candidates. The logistic part is fitted on the same rows.

Defined cases: null or empty texts have no clause and score what a text without matches scores; rows without doc_id are
scored and not held out; without labels of both kinds every score is the share of toxic labels (0 without labels); repeated
rows are scored each; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
TARGET_SCOPE = 4
NEGATION_SCOPE = 3
PREFIX_LENGTHS = range(4, 11)
WORD_CACHE = 150_000
PRUNE_AT = 300_000

# The words of the small transducers.
TARGETS = "you your yours yourself u ur they them their he him his she her this that these those people everyone tu te toi vous il elle ils elles eux lui ces du dich dir ihr euch sie er ihm ihn usted ustedes ellos ellas ella él ti vosotros".split()
NEGATIONS = "not never no isn't aren't wasn't weren't don't doesn't didn't cannot can't won't nobody without pas jamais ne non aucun sans nicht kein keine keinen nie niemals ohne nunca jamás ningún sin tampoco".split()
REPORTS = "said says say told tells reported reports quoted quotes wrote writes claimed claims alleged according stated dit disent raconte raconté affirme affirmé écrit selon prétend dijo dicen cuenta contó afirma afirmó escribió según sagte sagt berichtet schrieb schreibt behauptet erklärte laut".split()
THREATS = "kill killing murder hurt beat destroy shoot stab burn punch attack tuer frapper brûler détruire crever töten schlagen umbringen verbrennen erschießen matar golpear quemar destruir morir".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
PLAIN, DIRECTED, NEGATED, REPORTED = range(4)
TOKEN = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}]+)?|[.!?;\n]+|[\"“”«»]")
Table = dict[tuple[object, object], tuple[object, object]]


def _scope(trigger: int, width: int, mark: int, symbols: list) -> Table:
    """A machine that counts down from `width` after `trigger` and marks hits while it counts. A hit is (kind, outcome)."""
    table: Table = {}
    for left, s in product(range(width + 1), symbols):
        hit = isinstance(s, tuple)
        out = (s[0], mark) if hit and left and s[1] == PLAIN else s
        table[left, s] = (width if s == trigger else max(0, left - 1), out)
    return table


def _until_end(trigger: int, mark: int, symbols: list) -> Table:
    table: Table = {}
    for on, s in product((0, 1), symbols):
        out = (s[0], mark) if isinstance(s, tuple) and on and s[1] == PLAIN else s
        table[on, s] = (1 if s == trigger else on, out)
    return table


def _compose(first: Table, second: Table) -> Table:
    out: Table = {}
    states = sorted({q for q, _ in second}, key=repr)
    for (p, s), (p2, mid) in first.items():
        for q in states:
            q2, end = second[q, mid]
            out[(p, q), s] = ((p2, q2), end)
    return out


def grammar() -> tuple[list[list[tuple[int, int]]], int]:
    """The composed machine as rows by state and input symbol: (next state, output); output -1 is none, else 4 * threat +
    outcome. Order of the marks: negated, then reported, then directed."""
    hits = [(k, o) for k in (INSULT, THREAT) for o in (PLAIN, DIRECTED, NEGATED, REPORTED)]
    symbols = [OTHER, TARGET, NEGATION, REPORT, *hits]
    composed = _compose(_compose(_scope(NEGATION, NEGATION_SCOPE, NEGATED, symbols), _until_end(REPORT, REPORTED, symbols)), _scope(TARGET, TARGET_SCOPE, DIRECTED, symbols))
    start = ((0, 0), 0)
    number, rows, queue = {start: 0}, [], [start]
    while queue:
        q = queue.pop(0)
        row = []
        for s in range(6):
            nxt, out = composed[q, (s, PLAIN) if s in (INSULT, THREAT) else s]
            if nxt not in number:
                number[nxt] = len(number)
                queue.append(nxt)
            row.append((number[nxt], 4 * (out[0] == THREAT) + out[1] if isinstance(out, tuple) else -1))
        rows.append(row)
    return rows, 0


FIXED = {w: s for s, ws in ((THREAT, THREATS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS)) for w in ws}


class Scorer:
    """Sums of weights by output of whole texts."""

    N = 12

    def __init__(self, lexicon: dict[str, float]):
        self.words = {k[1:]: v for k, v in lexicon.items() if k[0] == "="}
        self.starts = {k[1:]: v for k, v in lexicon.items() if k[0] == "^"}
        self.machine, self.start = grammar()
        self.known: dict[str, tuple[int, float]] = {}

    def symbol(self, token: str) -> tuple[int, float]:
        w = token.lower().replace("’", "'")
        weight = max([self.words.get(w, 0.0), *(self.starts.get(w[:k], 0.0) for k in PREFIX_LENGTHS if k <= len(w))])
        if weight > 0:
            out = INSULT, weight
        elif token[0] in ".!?;\n":
            out = -1, 0.0
        elif token[0] in '"“”«»':
            out = REPORT, 0.0
        else:
            out = FIXED.get(w, OTHER), 1.0
        if len(self.known) >= WORD_CACHE:
            self.known.clear()
        self.known[token] = out
        return out

    def features(self, text: str) -> list[float]:
        """Sums of the 4 insult outputs and 4 threat outputs, their total over sqrt(words), clauses hit, the largest
        clause, and the number of different insults."""
        known, symbol, machine = self.known.get, self.symbol, self.machine
        tokens = TOKEN.findall(text)
        symbols = [known(t) or symbol(t) for t in tokens]
        sums = [0.0] * 8
        if not any(s == INSULT or s == THREAT for s, _ in symbols):
            return [0.0] * self.N
        state, clause, clauses, largest, words, met = self.start, 0.0, 0, 0.0, 0, set()
        for (s, weight), token in zip(symbols, tokens, strict=True):
            if s < 0:
                if clause:
                    clauses += 1
                    largest = max(largest, clause)
                state, clause = self.start, 0.0
                continue
            words += 1
            state, out = machine[state][s]
            if out >= 0:
                sums[out] += weight
                if s == INSULT:
                    clause += weight
                    met.add(token)
        clauses += clause > 0
        largest = max(largest, clause)
        return [*(math.log1p(x) for x in sums), sum(sums[:4]) / math.sqrt(words + 1), math.log1p(clauses), math.log1p(largest), math.log1p(len(met))]


def candidates(text: str) -> set[str]:
    """What may enter the lexicon: =word and ^beginning."""
    words = {t.lower().replace("’", "'") for t in TOKEN.findall(text) if t[0].isalpha()}
    out = {f"={w}" for w in words if len(w) > 2}
    out.update(f"^{w[:k]}" for w in words for k in PREFIX_LENGTHS if k <= len(w))
    return out


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """rows: text, toxic, the bounded training rows. Counts over them are distributed; all entries that are significant come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter = Counter()
        every: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(every)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([every[k] for k in keys], pa.int64())], names=["key", "n1", "n"])
            toxic.clear()
            every.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = candidates(text or "")
                every.update(found)
                if y:
                    toxic.update(found)
                if len(every) >= PRUNE_AT:
                    yield flush()
        yield flush()

    counts = rows.mapInArrow(tidy(count), "key string, n1 long, n long").groupBy("key").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    p = n_toxic / (n_toxic + n_clean)
    rate = F.col("n1") / F.col("n")
    other = F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - p))).otherwise(F.lit(0.0))
    counts = counts.where("n1 >= 4").where(rate > p).withColumn("bits", F.col("n") * (rate * F.log(rate / p) + other))
    odds = F.log((F.col("n1") + 0.5) / (n_toxic + 1)) - F.log((F.col("n") - F.col("n1") + 0.5) / (n_clean + 1))
    total = 2e5 + 50 * (n_toxic + n_clean)  # candidates grow with the rows
    found = counts.where(F.col("bits") >= math.log(total / 0.05)).where(odds > 1.5).select("key", odds.alias("odds")).orderBy("key")
    return {k: float(w) for k, w in found.collect()}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; the intercept is last and free."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, lexicon: dict[str, float], weights: np.ndarray, constant: float | None = None):
        self.lexicon, self.weights, self.constant = lexicon, weights, constant


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = materialise(rows, "toxicity-rows")  # train_rows at most; the corpus is read once for them
    counted = dict(rows.groupBy("toxic").count().collect())
    n1, n0 = counted.get(1, 0), counted.get(0, 0)
    if not n1 or not n0:
        return Model({}, np.zeros(Scorer.N + 1), n1 / max(1, n1 + n0))
    lexicon = learn_lexicon(rows, n1, n0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.features(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.float64())), batch.column(2), batch.column(0)], names=["f", "toxic", "doc_id"])

    known = rows.mapInArrow(tidy(features), "f array<double>, toxic int, doc_id long").orderBy("doc_id").toPandas()  # train_rows at most
    return Model(lexicon, fit(np.stack(known["f"].to_numpy()), known["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with tox_score and tox_predicted (in place of columns of these names)."""
    from pyspark.sql import types as T

    docs = docs.drop("tox_score", "tox_predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("tox_score", T.DoubleType()), T.StructField("tox_predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer = Scorer(own.lexicon)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([scorer.features(t or "") for t in texts]).reshape(len(texts), Scorer.N)
            s = 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ own.weights, -30, 30))) if own.constant is None else np.full(len(texts), own.constant)
            yield batch.append_column("tox_score", pa.array(s)).append_column("tox_predicted", pa.array((s >= threshold).astype(np.int32)))

    return docs.mapInArrow(tidy(run), schema)
