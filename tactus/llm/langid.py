"""Language identification by cross-parsing entropy.

For every language one suffix automaton is built over labelled text.  A text is parsed from left to right
into the longest phrases that occur in the labelled text; a language that needs few phrases knows the text.
A phrase costs log2 of the length of the labelled text (a pointer into it), so the cost of a language is
phrases * log2(length) / symbols, in bits per symbol, and the language of least cost wins.

Training sample (the only bound): whole rows, at most SAMPLE_ROWS a language, one of each of SAMPLE_ROWS hash classes:
the one of smallest hash among those of at most SAMPLE_LONGEST code points.  A language whose rows are all longer is
learned from its shortest row.  Predictions read whole texts.

The automata's edges are in one hash table, (state, letter) to state, so memory follows the number of edges (three a
letter of labelled text at most) whatever the number of different letters; each letter has a symbol of its own.

Long texts are parsed in lanes of LANE symbols side by side.  A lane is parsed again from the state in which the lane
before it ends until no lane's first state changes, so the phrases are those of one parse from left to right.

Defined cases: null text, empty text or no letter: `und`, score 0.  No labelled row at all: `und` for all.
Ties go to the language that sorts first.  Repeated rows each get a row.  Null doc_id: a row with null doc_id.
Extra columns are left out by predict_languages(), except those named in `keep`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import map_text

SAMPLE_ROWS, SAMPLE_LONGEST = 24, 8_192
UNDETERMINED = "und"
#: Symbols of a lane, and of its beginning, in which a parse that goes on from the lane before mostly meets one that begins there.
LANE, SYNC = 1_024, 64


def training_sample(docs: DataFrame, allowed: Column, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_LONGEST) -> dict[str, list[str]]:
    """Labelled text by language: of each of `rows` hash classes the allowed row of smallest hash (partial aggregation, no window)."""
    h = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    labelled = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n = F.length("text")
    # rows that are too long come after all others, the shortest first, and count only where no other row is found
    over = F.greatest(n - longest, F.lit(0))
    picked = labelled.select("lang", F.col("text").alias("t"), h.alias("h"), over.alias("over")).groupBy("lang", F.pmod("h", F.lit(rows)).alias("class")).agg(F.min_by("h", F.struct("over", "h")).alias("h"), F.min("over").alias("over"))
    best: dict[str, dict[int, tuple]] = {}
    for r in picked.collect():  # languages * rows hashes
        best.setdefault(r["lang"], {})[r["class"]] = (r["over"], r["h"])
    chosen = [(k, h) for k, v in best.items() for over, h in ([x for x in v.values() if not x[0]] or [min(v.values())])]
    if not chosen:
        return {}
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(chosen, "lang string, h long"))  # as many
    found: dict[str, dict[int, str]] = {}
    for r in labelled.select("lang", F.col("text").alias("t"), h.alias("h")).join(wanted, ["lang", "h"]).groupBy("lang", "h").agg(F.min("t").alias("t")).collect():
        found.setdefault(r["lang"], {})[r["h"]] = r["t"]
    return {k: [t for _, t in sorted(v.items())] for k, v in sorted(found.items())}


def normalise(text: str) -> str:
    """Lower case; each run of anything but letters becomes one space."""
    low = text.lower()
    if low.isalpha():
        return low
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ok = _letters()[points]
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # a letter, or the first other sign after one
    out = np.where(ok, points, 32)[keep]
    return out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


_cache: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _cache:
        _cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _cache["letters"]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Edges of each state of the suffix automaton of a sequence of symbols; state 0 is the start."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Edges:
    """A map from whole numbers to whole numbers by hashing, looked up many at a time.

    A key is in one of two neighbouring places, or, where both were taken, in a sorted rest; an entry is key and value
    in one integer, so most lookups read one word.
    """

    MIX = np.int64(-0x61C8864680B583EB)  # the golden ratio of 64 bits

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())  # at most half full
        self.shift, self.last = np.int64(64 - bits), np.int64((1 << bits) - 1)
        self.low = np.int64(int(values.max(initial=0)).bit_length())
        if int(keys.max(initial=0)).bit_length() + int(self.low) > 62:
            raise ValueError("keys and values together take more than 62 bits")
        self.mask = np.int64((1 << int(self.low)) - 1)
        self.entry = np.full((1 << bits) + 1, -1, dtype=np.int64)
        at, made = self.slot(keys), keys << self.low | values
        for step in (0, 1):
            free = np.flatnonzero(self.entry[at + step] == -1)
            put = free[np.unique(at[free], return_index=True)[1]]
            self.entry[at[put] + step] = made[put]
            at, made = np.delete(at, put), np.delete(made, put)
        self.rest = np.append(np.sort(made), np.int64(2**63 - 1))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        at = keys * self.MIX
        at ^= at >> np.int64(29)
        at *= self.MIX
        at >>= self.shift
        at &= self.last
        return at

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values of an array of keys, -1 where there is none."""
        shape, keys = keys.shape, keys.ravel()
        at = self.slot(keys)
        held = self.entry.take(at)
        wrong = held >> self.low != keys  # a free place is -1
        other = np.flatnonzero(wrong & (held >= 0))
        if len(other):
            found = self.entry.take(at[other] + 1)
            last = np.flatnonzero((found >> self.low != keys[other]) & (found >= 0))
            found[last] = self.rest.take(np.searchsorted(self.rest, keys[other[last]] << self.low))
            held[other] = found
            wrong[other] = found >> self.low != keys[other]
        held &= self.mask
        held[wrong] = -1
        return held.reshape(shape)


class Parser:
    """The automata of all languages in one table of edges, and the parse of many texts in step."""

    def __init__(self, sample: dict[str, list[str]]):
        self.langs = sorted(sample)
        texts = [" " + " ".join(normalise(t).strip() for t in sample[k]) + " " for k in self.langs]
        seen = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        self.k = 1 + len(seen)
        # symbol 0 occurs in no labelled text: a letter that no language knows is a phrase of its own
        self.symbol = np.zeros(0x110000, dtype=np.int32)
        self.symbol[seen] = 1 + np.arange(len(seen))
        keys, values, at = [], [], 0
        self.begin = np.zeros((len(texts), self.k), dtype=np.int64)  # the state after the first symbol of a phrase
        for n, t in enumerate(texts):
            states = suffix_automaton(self.codes(t).tolist())
            # the start state has no edges here, so that each phrase begins by way of `begin`
            edges = [(at + s) * self.k + c for s, m in enumerate(states) if s for c in m]
            keys.append(np.array(edges, dtype=np.int64))
            values.append(np.array([at + to for s, m in enumerate(states) if s for to in m.values()], dtype=np.int64))
            self.begin[n] = at
            for c, to in states[0].items():
                self.begin[n, c] = at + to
            at += len(states)
        self.roots = self.begin[:, 0].copy()
        self.edges = Edges(np.concatenate(keys), np.concatenate(values)) if keys else None
        self.bits = np.array([np.log2(max(2, len(t))) for t in texts])

    def codes(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    def phrases(self, texts: list[str], lane: int = LANE, sync: int = SYNC) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (texts, languages) and symbols of each text."""
        coded = [self.codes(t) for t in texts]
        size = np.array([len(c) for c in coded], dtype=np.int64)
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        lanes = np.array([(i, a, min(lane, n - a)) for i, n in enumerate(size.tolist()) for a in range(0, n, lane)], dtype=np.int64).reshape(-1, 3)
        if not len(lanes) or not self.langs:
            return out, size
        flat, first = np.concatenate(coded), np.cumsum(size) - size
        at, long = first[lanes[:, 0]] + lanes[:, 1], lanes[:, 2]
        begin = np.repeat(self.roots[:, None], len(lanes), axis=1)
        end, count, early_end, early_count = self.walk(flat, at, long, begin, sync)
        follows = np.flatnonzero(lanes[:, 1] > 0)  # lanes that go on where the lane before them ends
        while True:
            follows = follows[(end[:, follows - 1] != begin[:, follows]).any(axis=0)]
            if not len(follows):
                break
            begin[:, follows] = end[:, follows - 1]
            # most parses meet the one that began anew within a few phrases; then only what is before that changes
            short = np.minimum(long[follows], sync)
            state, n, _, _ = self.walk(flat, at[follows], short, begin[:, follows], sync)
            met = (state == early_end[:, follows]).all(axis=0)
            count[:, follows] += np.where(met, n - early_count[:, follows], 0)
            early_count[:, follows] = np.where(met, n, early_count[:, follows])
            other = follows[~met]
            if len(other):
                end[:, other], count[:, other], early_end[:, other], early_count[:, other] = self.walk(flat, at[other], long[other], begin[:, other], sync)
            follows = np.unique(np.concatenate([follows, other + 1]))
            follows = follows[follows < len(lanes)]
            follows = follows[lanes[follows, 1] > 0]
        np.add.at(out, lanes[:, 0], count.T)
        return out, size

    def walk(self, flat: np.ndarray, at: np.ndarray, long: np.ndarray, begin: np.ndarray, sync: int) -> tuple[np.ndarray, ...]:
        """State after each lane (languages, lanes) and the phrases that begin in it; both after `sync` symbols, too."""
        order = np.argsort(-long, kind="stable")
        at, long, state = at[order], long[order], begin[:, order]
        count = np.zeros(state.shape, dtype=np.int32)
        early = None
        live = np.searchsorted(-long, -np.arange(1, long[0] + 1), side="right").tolist()  # lanes longer than each step
        for t, n in enumerate(live):
            if t == sync:
                early = state.copy(), count.copy()
            c = flat[at[:n] + t]
            to = self.edges(state[:, :n] * self.k + c)
            new = to < 0
            np.copyto(to, self.begin.take(c, axis=1), where=new)
            state[:, :n] = to
            count[:, :n] += new
        early = early or (state, count)
        back = np.argsort(order)
        return state[:, back], count[:, back], early[0][:, back], early[1][:, back]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        clean = [normalise(t).strip() if t else "" for t in texts]
        n, size = self.phrases(clean)
        lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return lang, score
        cost = n * self.bits[None, :] / np.maximum(size, 1)[:, None]
        best = cost.argmin(axis=1)
        low = np.sort(cost, axis=1)
        margin = 1.0 - low[:, 0] / np.maximum(low[:, 1], 1e-12) if len(self.langs) > 1 else np.ones(len(texts))
        for i in np.flatnonzero(size > 0):
            lang[i], score[i] = self.langs[best[i]], min(1.0, max(0.0, float(margin[i])))
        return lang, score


def predict_languages(docs: DataFrame, sample: dict[str, list[str]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of docs with lang_pred and score; only `text` is an input of the prediction."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(sample)  # languages * SAMPLE_ROWS * SAMPLE_LONGEST at most, or a row a language

    def start():
        key = hash(tuple((k, *v) for k, v in known.value.items()))
        if _cache.get("key") != key:  # a worker keeps its automata for the next task
            _cache.update(key=key, parser=Parser(known.value))

        def make(texts: list) -> dict[str, list]:
            langs, scores = _cache["parser"].predict(texts)
            return {"lang_pred": langs, "score": scores.tolist()}

        return make

    return map_text(docs, "text" if "text" in keep else F.col("text"), keep, "lang_pred string, score double", start)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1(docs: DataFrame) -> DataFrame:
    sample = training_sample(docs, ~is_held_out(F.col("doc_id")))
    found = predict_languages(docs, sample)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
