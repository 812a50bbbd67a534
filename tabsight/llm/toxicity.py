"""Toxicity scores from a learned lexicon, matched with typing errors.

* *Lexicon.*  Words whose document frequency is far higher among toxic than
  among other training texts.
* *Matching.*  The lexicon is a trie; a Levenshtein automaton walks it, so one
  pass over a word finds every term within its allowed edits.  The product is
  made deterministic as it is used: (state, character) pairs fill a dense
  table, and all words of a chunk step through it together.  Most words reach
  the dead state after a few characters.
* *Context.*  Each match is scored inside a window of words: whether it stands
  in quotation marks, and how far the words around it speak for toxic texts.
* *Score.*  A logistic model over the text's match and context features.

Training uses a bounded sample of the labelled rows (``max_rows``, chosen by
hash); every text of the corpus is scored whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, ships, text_rows

#: Bound on the labelled rows that the model is fitted on.
MAX_ROWS = 20_000
MIN_SUPPORT = 3
#: Every word of the sample with this log ratio and support is a term.
MIN_LLR = 2.0
WINDOW = 6
HELD_OUT_REMAINDER = 2
THRESHOLD = 0.3
_CHUNK_CHARS = 1 << 20
_TABLE = 0x300
_OTHER = 1
N_FEATURES = 7


#: Of every code point below 0x300: 1 for letters and digits, else 0.
WORD_CHARACTERS = np.array([int(chr(c).isalnum()) for c in range(_TABLE)], dtype=np.int16)
#: Marks that open a quotation, and those that close it.
CLOSES = {"„": "“”", "“": "”", "«": "»", "»": "«"}


def classes_of(codes: np.ndarray, table: np.ndarray = WORD_CHARACTERS) -> np.ndarray:
    """0 for what is no part of a word; other classes as in ``table`` (1 for
    any character that it does not tell apart)."""
    high = codes >= _TABLE
    if not high.any():
        return table[codes]
    out = table[np.minimum(codes, _TABLE - 1)]
    out[high] = ((codes[high] >= 0x370) & (codes[high] < 0x2000)) | (codes[high] >= 0x2C00)
    return out


def quoted(before: str, after: str) -> bool:
    """Whether a quotation opens in ``before``, is still open at its end and
    closes in ``after``.  Straight marks open and close in turn; the others by
    their form („ closes with “)."""
    if before.count('"') % 2 and '"' in after:
        return True
    opened = ""
    for c in before:
        if opened and c in CLOSES[opened]:
            opened = ""
        elif c in CLOSES:
            opened = c
    return bool(opened) and any(c in CLOSES[opened] for c in after)


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 12 else 2


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[int, int]] = [{}]
        self.limit = [0]
        self.term = [-1]
        self.longest = 0
        # one class for each letter of a term, one for all other characters of words
        self.classes = WORD_CHARACTERS.copy()
        letters = sorted({ord(c) for t in terms for c in t if ord(c) < _TABLE and c.isalnum()})
        self.classes[letters] = np.arange(_OTHER + 1, _OTHER + 1 + len(letters))
        # the letters of other scripts: sorted code points, classes after those of the table
        self.high = np.array(sorted({ord(c) for t in terms for c in t if ord(c) >= _TABLE}), dtype=np.int64)
        self.first_high = _OTHER + 1 + len(letters)
        self.n_classes = self.first_high + len(self.high)
        for i, t in enumerate(terms):
            codes = self.classify(np.array([ord(c) for c in t])).tolist()
            node, edits = 0, allowed_edits(t)
            self.limit[0] = max(self.limit[0], edits)
            for c in codes:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.term)
                    self.children[node][c] = nxt
                    self.children.append({})
                    self.limit.append(0)
                    self.term.append(-1)
                node = nxt
                self.limit[node] = max(self.limit[node], edits)
            if self.term[node] < 0:
                self.term[node] = i
            self.longest = max(self.longest, len(t) + edits)
        self.allowed = [allowed_edits(t) for t in terms]
        self.sets: list[tuple] = [()]
        self.number: dict[tuple, int] = {(): 0}
        self.table = np.full((1024, self.n_classes), -1, dtype=np.int32)
        self.table[0] = 0
        self.edits = np.full(1024, -1, dtype=np.int8)
        self.hit = np.full(1024, -1, dtype=np.int32)
        self.start = self._state({0: 0}) if terms else 0

    def classify(self, codes: np.ndarray) -> np.ndarray:
        """Classes of characters: each letter of a term has its own, whatever
        its script; ``_OTHER`` is no letter of any term."""
        out = classes_of(codes, self.classes)
        if len(self.high):
            above = np.flatnonzero(codes >= _TABLE)
            at = np.minimum(np.searchsorted(self.high, codes[above]), len(self.high) - 1)
            known = self.high[at] == codes[above]
            out = out.copy()
            out[above[known]] = self.first_high + at[known]
        return out

    def _state(self, found: dict[int, int]) -> int:
        """Number of a set of (trie node: edits so far), closed under term
        characters that the word leaves out."""
        todo = list(found.items())
        while todo:
            node, e = todo.pop()
            if found[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.limit[child] and found.get(child, 99) > e + 1:
                    found[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(found.items()))
        state = self.number.get(key)
        if state is None:
            state = len(self.sets)
            self.number[key] = state
            self.sets.append(key)
            if state >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.edits = np.concatenate([self.edits, np.full_like(self.edits, -1)])
                self.hit = np.concatenate([self.hit, np.full_like(self.hit, -1)])
            best = min(((e, self.term[n]) for n, e in key
                        if self.term[n] >= 0 and e <= self.allowed[self.term[n]]), default=None)
            if best:
                self.edits[state], self.hit[state] = best
        return state

    def _step(self, state: int, c: int) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state]:
            same = self.children[node].get(c)
            if same is not None and out.get(same, 99) > e:
                out[same] = e
            if e + 1 <= self.limit[node] and out.get(node, 99) > e + 1:
                out[node] = e + 1  # a character too many
            for child in self.children[node].values():
                if e + 1 <= self.limit[child] and out.get(child, 99) > e + 1:
                    out[child] = e + 1  # another character
        return self._state(out) if out else 0

    def match(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray):
        """(edits, term) of every word; -1 where no term is near enough."""
        classes = self.classify(codes)
        edits = np.full(len(start), -1, dtype=np.int8)
        hit = np.full(len(start), -1, dtype=np.int32)
        live = np.flatnonzero(length <= self.longest)
        state = np.full(len(live), self.start, dtype=np.int32)
        at = 0
        while len(live):
            c = classes[start[live] + at]
            new = self.table[state, c]
            missing = np.flatnonzero(new < 0)
            if len(missing):
                pairs = np.unique(state[missing].astype(np.int64) * self.n_classes + c[missing])
                for p in pairs.tolist():
                    s, k = divmod(p, self.n_classes)
                    self.table[s, k] = self._step(s, k)
                new = self.table[state, c]
            at += 1
            over = length[live] == at
            if over.any():
                done = live[over]
                edits[done], hit[done] = self.edits[new[over]], self.hit[new[over]]
            go = (new != 0) & ~over
            live, state = live[go], new[go]
        return edits, hit


def chunks_of(texts: Iterator[str]) -> Iterator[tuple[list[int], list[str]]]:
    rows, group, size = [], [], 0
    for i, t in enumerate(texts):
        rows.append(i)
        group.append(t.lower())
        size += len(t)
        if size >= _CHUNK_CHARS:
            yield rows, group
            rows, group, size = [], [], 0
    if rows:
        yield rows, group


def words_in(group: list[str]):
    """The joined texts, their code points, word starts and lengths, the
    document of each word, and where each document begins."""
    joined = "\n".join(group)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    classes = classes_of(codes)
    inside = np.concatenate([[False], classes > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    size = np.array([len(t) + 1 for t in group], dtype=np.int64)
    begin = np.cumsum(size) - size
    doc = np.searchsorted(begin, start, side="right") - 1
    return joined, codes, start, end - start, doc, begin


class Model:
    """Lexicon, known forms, context words and the logistic weights."""

    def __init__(self, terms: list[str], weights: list[float]):
        self.terms, self.weights = terms, weights
        self.automaton = Automaton(terms)
        self.forms: dict[str, float] = {}
        self.context: dict[str, float] = {}
        self.mean = np.zeros(N_FEATURES)
        self.scale = np.ones(N_FEATURES)
        self.beta = np.zeros(N_FEATURES + 1)

    def state(self) -> dict:
        """Plain values, for a broadcast; :meth:`restore` is its inverse.  The
        automaton takes along the states it has met so far."""
        own = {k: v for k, v in self.__dict__.items() if k != "automaton"}
        known = {k: getattr(self.automaton, k) for k in ("sets", "number", "table", "edits", "hit")}
        return {"model": own, "automaton": known}

    @classmethod
    def restore(cls, state: dict) -> "Model":
        out = cls(state["model"]["terms"], state["model"]["weights"])
        out.__dict__.update(state["model"])
        known = state["automaton"]
        out.automaton.__dict__.update(sets=list(known["sets"]), number=dict(known["number"]),
                                      table=known["table"].copy(), edits=known["edits"].copy(),
                                      hit=known["hit"].copy())
        return out

    def matches(self, group: list[str]):
        """(document, word index, form, weight, quoted) of each match, and the
        words of the chunk."""
        joined, codes, start, length, doc, begin = words_in(group)
        edits, hit = self.automaton.match(codes, start, length)
        idx = np.flatnonzero(hit >= 0)
        low, high = np.searchsorted(doc, doc[idx]), np.searchsorted(doc, doc[idx], side="right")
        low, high = np.maximum(idx - WINDOW, low), np.minimum(idx + WINDOW, high - 1)
        out = []
        for i, d, e, t, a, b in zip(idx.tolist(), doc[idx].tolist(), edits[idx].tolist(), hit[idx].tolist(),
                                    low.tolist(), high.tolist()):
            form = joined[start[i]:start[i] + length[i]]
            # marks between the first and the last word of the window, and those beside them
            first, last = max(start[a] - 1, begin[d]), start[b] + length[b] + 1
            q = quoted(joined[first:start[i]], joined[start[i] + length[i]:last])
            w = self.forms.get(form)
            if w is None:
                w = self.weights[t] * (1.0, 0.7, 0.4)[e]
            if w > 0:
                out.append((d, i, form, w, q))
        return out, joined, start, length, doc

    def window(self, joined, start, length, doc, i: int) -> list[str]:
        lo, hi = max(0, i - WINDOW), min(len(start), i + WINDOW + 1)
        return [joined[start[k]:start[k] + length[k]] for k in range(lo, hi) if k != i and doc[k] == doc[i]]

    def features(self, group: list[str]) -> np.ndarray:
        found, joined, start, length, doc = self.matches(group)
        out = np.zeros((len(group), N_FEATURES))
        words = np.bincount(doc, minlength=len(group)) if len(doc) else np.zeros(len(group))
        near: dict[int, list[float]] = defaultdict(list)
        for d, i, _, w, quoted in found:
            c = [self.context[x] for x in self.window(joined, start, length, doc, i) if x in self.context]
            c = sum(c) / len(c) if c else 0.0
            near[d].append(c)
            k = 2 if quoted else 0
            out[d, k] = max(out[d, k], w)
            out[d, k + 1] += w
            out[d, 4] = max(out[d, 4], w + c)
        out[:, 1], out[:, 3] = np.log1p(out[:, 1]), np.log1p(out[:, 3])
        for d, c in near.items():
            out[d, 5] = sum(c) / len(c)
            out[d, 6] = len(c) / np.log2(2 + words[d])
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.beta[0] + ((features - self.mean) / self.scale) @ self.beta[1:]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, features: np.ndarray, label: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> None:
        """Ridge logistic regression by Newton steps."""
        self.mean = features.mean(axis=0)
        self.scale = np.where(features.std(axis=0) > 1e-9, features.std(axis=0), 1.0)
        x = np.column_stack([np.ones(len(features)), (features - self.mean) / self.scale])
        penalty = np.full(x.shape[1], ridge)
        penalty[0] = 1e-3
        beta = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((x * w[:, None]).T @ x + np.diag(penalty), x.T @ (label - p) - penalty * beta)
            beta += step
            if np.abs(step).max() < 1e-8:
                break
        self.beta = beta


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        for rows, group in chunks_of(x or "" for x in batch.column("text").to_pylist()):
            joined, _, start, length, doc, _ = words_in(group)
            seen: dict[str, list[int]] = {}
            pairs = {(d, joined[s:s + n]) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())}
            for d, w in pairs:
                c = seen.setdefault(w, [0, 0])
                c[toxic[rows[d]]] += 1
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(list(seen), pa.string()),
                "clean": pa.array([c[0] for c in seen.values()], pa.int64()),
                "toxic": pa.array([c[1] for c in seen.values()], pa.int64())})


def _llr(toxic, clean, n_toxic, n_clean):
    return float(np.log((toxic + 0.5) / (n_toxic + 1.0)) - np.log((clean + 0.5) / (n_clean + 1.0)))


def _forms(shared):
    def run(batches):
        model = Model.restore(shared.value)
        for batch in batches:
            words = batch.column("word").to_pylist()
            keep = []
            for rows, group in chunks_of(words):
                _, codes, start, length, doc, _ = words_in(group)
                _, hit = model.automaton.match(codes, start, length)
                keep += [rows[d] for d in doc[hit >= 0].tolist()]
            yield batch.take(pa.array(sorted(set(keep)), pa.int64()))
    return run


def _windows(shared):
    def run(batches):
        model = Model.restore(shared.value)
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            count: dict[str, list[int]] = {}
            for rows, group in chunks_of(x or "" for x in batch.column("text").to_pylist()):
                found, joined, start, length, doc = model.matches(group)
                for d, i, *_ in found:
                    for w in set(model.window(joined, start, length, doc, i)):
                        count.setdefault(w, [0, 0])[toxic[rows[d]]] += 1
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(list(count), pa.string()),
                "clean": pa.array([c[0] for c in count.values()], pa.int64()),
                "toxic": pa.array([c[1] for c in count.values()], pa.int64())})
    return run


def _featured(shared):
    def run(batches):
        model = Model.restore(shared.value)
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for rows, group in chunks_of(x or "" for x in batch.column("text").to_pylist()):
                f = model.features(group)
                yield pa.RecordBatch.from_pydict({
                    "toxic": pa.array([toxic[i] for i in rows], pa.int32()),
                    "features": pa.array(f.tolist(), pa.list_(pa.float64()))})
    return run


def _scored(shared):
    def run(batches):
        model = Model.restore(shared.value)
        for batch in batches:
            ids = batch.column("doc_id")
            for rows, group in chunks_of(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(rows[0], len(rows)),
                    "score": pa.array(model.score(model.features(group)), pa.float64())})
    return run


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT_REMAINDER


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``text, toxic`` of about ``max_rows`` labelled rows outside the held-out
    share, chosen by the hash of their id (all, if there are no more)."""
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")) \
        .filter("_id is not null and toxic in (0, 1)").filter(~held_out(F.col("_id"))) \
        .groupBy("_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    if n > max_rows:
        usable = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    rows = text_rows(docs)
    # at most about max_rows rows of twelve bytes, hence the broadcast
    return rows.join(F.broadcast(usable), rows.doc_id == F.col("_id")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits the model; lexicon, context words and features of the bounded
    sample are all that reaches the driver.  Terms under four letters match
    without edits."""
    sc = docs.sparkSession.sparkContext
    sample = cut_lineage(training_rows(docs, labels, max_rows).repartition(8))
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if n_toxic == 0:
        return Model([], [])
    words = cut_lineage(sample.mapInArrow(_word_sets, "word string, clean long, toxic long")
                        .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    llr = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    picked = words.withColumn("llr", llr) \
        .filter((F.col("llr") >= MIN_LLR) & (F.col("toxic") >= MIN_SUPPORT)) \
        .orderBy(F.desc(F.round(F.col("llr") * F.col("toxic"), 6)), "word").collect()
    model = Model([r.word for r in picked], [r.llr for r in picked])
    near = words.mapInArrow(_forms(sc.broadcast(model.state())), words.schema).collect()
    model.features([r.word for r in near] + model.terms)  # the automaton meets its usual states
    model.forms = {r.word: _llr(r.toxic, r.clean, n_toxic, n_clean) for r in near if r.toxic + r.clean >= 2}
    around = sample.mapInArrow(_windows(sc.broadcast(model.state())), "word string, clean long, toxic long") \
        .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")) \
        .filter("clean + toxic >= 5").orderBy(F.desc(F.col("clean") + F.col("toxic")), "word").collect()
    in_toxic, in_clean = sum(r.toxic for r in around), sum(r.clean for r in around)
    if in_toxic and in_clean:
        model.context = {r.word: _llr(r.toxic, r.clean, in_toxic, in_clean) for r in around}
    rows = sample.mapInArrow(_featured(sc.broadcast(model.state())), "toxic int, features array<double>").collect()
    rows.sort(key=lambda r: (r.toxic, r.features))
    model.fit(np.array([r.features for r in rows]), np.array([r.toxic for r in rows], dtype=float))
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts score like any text without a match.  A null id is
    not held out.  Repeated rows score alike, empty tables give an empty
    result, other columns are ignored.  Without toxic training
    rows nothing is known and every text scores 0.
    """
    rows = text_rows(docs)
    if not model.terms and not model.beta.any():
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        scored = rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model.state())),
                                 "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


ships(__name__)
