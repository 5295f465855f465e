"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon maps words to symbols (insult, threat, target, negation, report, the speaker, a modal, a vow, an intensifier).
Five transducers read the symbols of a clause: insult (is it intensified), threat (bare, with a modal, or announced by
the speaker), target (named before the head, or within the clause after it), negation (its scope in words) and reported
speech. Composed into one machine, they write a matched event for each head. Event weights start at the grammar's own
values and are fitted to labelled rows; no word is scored outside a matched clause.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_of_id, dropped, lean, slices, stored

#: Documented bounds of the labelled sample and of what is learned from it.
SAMPLE_ROWS, LEARNED_STEMS, MIN_POSITIVE, MIN_PRECISION = 12_000, 600, 8, 0.9
#: Lengths of the word beginnings that are tried as stems.
STEMS = (4, 6, 8)

# Fixed word lists of the grammar.
INSULTS = "idiot idiots moron morons stupid worthless pathetic disgusting trash scum loser losers clown clowns imbecile dumb fool filth vermin idiote imbécile crétin abruti ordure débile minable nul pourriture bouffon dumm dummkopf trottel versager abschaum widerlich erbärmlich wertlos müll estúpido idiota imbécil basura escoria patético asqueroso inútil payaso perdedor".split()
THREATS = "kill hurt destroy smash strangle murder burn tuer frapper détruire écraser töten umbringen vernichten zerschlagen matar destruir golpear aplastar".split()
TARGETS = "you your yours yourself he she they them his her their him u tu te toi vous ton ta tes votre il elle ils du dich dir dein deine ihr euch er sie tú ti usted ustedes tus su sus él ella ellos".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't cannot can't won't nobody pas jamais aucun nicht nie kein keine nunca jamás ningún tampoco".split()
REPORTS = "said says wrote quoted called calls reported claimed alleged told according dit écrit appelé selon sagte schrieb nannte laut dijo escribió llamó según".split()
SPEAKERS = "i we je nous ich wir yo nosotros".split()
MODALS = "will shall should must gonna going deserve deserves sollte soll doit devrait debe debería".split()
VOWS = "i'll we'll i'm we're werde werden vais allons voy vamos".split()
INTENSIFIERS = "so such complete completely total totally utter utterly absolute absolutely real very most si tellement totalement völlig ganz sehr muy tan completo".split()
SYMBOLS = I, T, G, N, R, S, M, V, X, O = range(10)  # insult, threat, target, negation, report, speaker, modal, vow, intensifier, other word
SCOPE = 3  # words that a negation reaches
NEAR = 2  # words that an intensifier reaches

#: An event is (kind, level, negated, reported, target): level of an insult 0 or 1 (intensified), of a threat 0 (bare), 1 (modal) or 2 (announced); target 0 (none), 1 (before the head) or 2 (after it).
EVENTS = [(k, v, n, r, t) for k, levels in ((I, 2), (T, 3)) for v in range(levels) for n in (0, 1) for r in (0, 1) for t in (0, 1, 2)]
PRIOR = np.array([(3.0 + 0.3 * v if k == I else 1.0 + v) + (t > 0) - 1.5 * n - 1.0 * r for k, v, n, r, t in EVENTS])
BIAS = -2.5

_CLAUSE_END = re.compile(r"[.!?;:\n]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def insult(state: int, symbol: int) -> tuple[int, int]:
    """Counts down from an intensifier; writes 1 at an insult that it reaches."""
    return (NEAR + 1 if symbol == X else max(0, state - 1)), int(symbol == I and state > 1)


def threat(state: int, symbol: int) -> tuple[int, int]:
    """States: nothing, modal, speaker, both. Writes the level at a threat."""
    if symbol == T:
        return state, (0, 1, 0, 2)[state]
    return (3 if symbol == V else state | 1 if symbol == M else state | 2 if symbol == S else state), 0


def target(state: int, symbol: int) -> tuple[int, int]:
    """States: no target, target seen, a head waits for one. Writes 1 at a head behind a target, 2 at a target that a head waits for."""
    if symbol == G:
        return 1, 2 * (state == 2)
    return (2, 0) if symbol in (I, T) and state != 1 else (state, int(symbol in (I, T)))


def negation(state: int, symbol: int) -> tuple[int, int]:
    state = SCOPE if symbol == N else max(0, state - 1)
    return state, int(state > 0 and symbol != N)


def reported(state: int, symbol: int) -> tuple[int, int]:
    state = int(state or symbol == R)
    return state, state


def compose(parts=((insult, NEAR + 2), (threat, 4), (target, 3), (negation, SCOPE + 1), (reported, 2))) -> list[list[tuple[int, tuple[int, ...]]]]:
    """Product machine: machine[state][symbol] = next state and the outputs of the parts."""
    sizes = [n for _, n in parts]
    machine = []
    for state in range(int(np.prod(sizes))):
        own = np.unravel_index(state, sizes)
        row = []
        for symbol in SYMBOLS:
            steps = [f(int(s), symbol) for (f, _), s in zip(parts, own, strict=True)]
            row.append((int(np.ravel_multi_index([s for s, _ in steps], sizes)), tuple(o for _, o in steps)))
        machine.append(row)
    return machine


def events(machine, symbols: list[int]) -> list[tuple[int, int, int, int, int]]:
    """The events of a clause. All heads that wait when a target comes get it; at the end of the clause the others have none."""
    state, out, waiting = 0, [], []
    for s in symbols:
        state, (strong, level, aimed, n, r) = machine[state][s]
        if s in (I, T):
            out.append((s, strong if s == I else level, n, r, aimed))
            if not aimed:
                waiting.append(len(out) - 1)
        elif aimed:
            for k in waiting:
                out[k] = (*out[k][:4], aimed)
            waiting = []
    return out


class Grammar:
    def __init__(self, stems: list[str]):
        import ahocorasick

        self.stems = set(stems)

        self.symbol = {w: k for k, words in ((X, INTENSIFIERS), (M, MODALS), (V, VOWS), (S, SPEAKERS), (R, REPORTS), (N, NEGATIONS), (G, TARGETS), (T, THREATS), (I, INSULTS)) for w in words}
        self.heads = ahocorasick.Automaton()
        for w, s in self.symbol.items():
            if s in (I, T):
                self.heads.add_word(w, (len(w), False))
        for w in self.stems:
            self.heads.add_word(w, (len(w), True))
        self.heads.make_automaton()
        self.machine = compose()
        self.event = {e: k for k, e in enumerate(EVENTS)}

    def of(self, word: str) -> int:
        s = self.symbol.get(word, O)
        return I if s == O and any(word[:k] in self.stems for k in STEMS if k <= len(word)) else s

    def clause(self, text: str, found: np.ndarray) -> None:
        """Count the events of a clause."""
        for e in events(self.machine, [self.of(w) for w in _WORD.findall(text)]):
            found[self.event[e]] += 1

    def features(self, text: str | None) -> np.ndarray:
        """Count of each event in the whole text."""
        found = np.zeros(len(EVENTS))
        low = (text or "").lower()
        done = -1  # where the last clause with a head ended
        for end, (n, stem) in self.heads.iter(low):
            a = end - n + 1
            if a < done or a and low[a - 1].isalpha() or not stem and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            start = max(low.rfind(c, max(done, 0), a) for c in ".!?;:\n") + 1  # no clause begins before the last one's end
            stop = m.start() if (m := _CLAUSE_END.search(low, end)) else len(low)
            self.clause(low[start:stop], found)
            done = stop
        return found


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most rows labelled documents, those with the smallest hash of the id; rows with a null id, text or label are left out, equal texts count once."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Learn stems of insults and event weights from a bounded sample. Without labelled rows the grammar's own weights hold."""
    bounded_batches(docs.sparkSession)
    s = stored(sample(docs, labels), "toxicity-sample")
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")))
    words = s.select(F.monotonically_increasing_id().alias("d"), "toxic", word.alias("w"))
    stem = words.select("d", "toxic", F.explode(F.array(*(F.when(F.length("w") >= k, F.left("w", F.lit(k))) for k in STEMS))).alias("stem")).filter("stem is not null").distinct()
    per = stem.groupBy("stem").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).filter((F.col("pos") >= MIN_POSITIVE) & (F.col("pos") >= MIN_PRECISION * F.col("n")))
    insults = [r.stem for r in per.orderBy(F.desc("pos"), "stem").limit(LEARNED_STEMS).collect()]

    def run(batches):
        g = Grammar(insults)
        for batch in batches:
            for b in slices(batch, "text", 1 << 20, 4096):
                f = [g.features(t).astype(int).tolist() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(f, pa.list_(pa.int64()))], names=["toxic", "f"])

    got = s.select("text", "toxic").mapInArrow(lean(run), "toxic int, f array<long>").groupBy("toxic", "f").count().collect()
    dropped(s)
    return {"insults": insults, "weights": _logistic(got)}


def _logistic(rows) -> list[float]:
    """MAP logistic regression, Newton's steps, Gaussian prior around the grammar's weights."""
    prior = np.append(PRIOR, BIAS)
    if not rows:
        return prior.tolist()
    rows = sorted(rows, key=lambda r: (r["toxic"], r["f"]))
    x = np.array([[*np.log1p(r["f"]), 1.0] for r in rows])
    y, m = np.array([float(r["toxic"] > 0) for r in rows]), np.array([float(r["count"]) for r in rows])
    w, tau = prior.copy(), 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (m * (y - p)) - tau * (w - prior)
        h = (x * (m * p * (1 - p))[:, None]).T @ x + tau * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) and n_matches of each row of docs(doc_id, text).

    The whole text is read, however long, clause by clause. Null and empty texts get the score of no match; repeated rows
    get the same score; an empty table gives an empty result; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64())
    names = ["doc_id", "id_crc", "score", "predicted", "n_matches"]

    def run(batches):
        g, w = Grammar(shipped.value["insults"]), np.array(shipped.value["weights"])
        for batch in batches:
            for b in slices(batch, "text", 1 << 20, 4096):
                f = np.array([g.features(t) for t in b.column("text").to_pylist()]).reshape(len(b), len(EVENTS))
                p = 1 / (1 + np.exp(-np.clip(np.log1p(f) @ w[:-1] + w[-1], -30, 30)))
                cols = (b.column("doc_id"), b.column("id_crc"), p, p >= 0.5, f.sum(1).astype(np.int64))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), crc_of_id().alias("id_crc"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(lean(run), "doc_id long, id_crc long, score double, predicted int, n_matches long")


def held_out_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of rows whose crc32(doc_id) mod 5 is not 0, score all."""
    got = toxicity(docs, fit(docs, labels.filter(crc_of_id() % 5 != 0)))
    return got.select("doc_id", (F.col("id_crc") % 5 == 0).alias("held_out"), "score", "predicted", "n_matches")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns kept, that toxicity doesn't reject. Null and empty texts stay, repeated rows stay or go together; an empty table stays empty."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.filter(crc_of_id() % 5 != 0)))

    def run(batches):
        g, w = Grammar(model.value["insults"]), np.array(model.value["weights"])
        for batch in batches:
            for b in slices(batch, "__text", 1 << 20, 4096):
                f = np.array([g.features(t) for t in b.column("__text").to_pylist()]).reshape(len(b), len(EVENTS))
                yield b.filter(pa.array(np.log1p(f) @ w[:-1] + w[-1] < 0)).select(own)

    own = docs.columns
    return docs.withColumn("__text", F.col("text").cast("string")).mapInArrow(lean(run), docs.schema)
