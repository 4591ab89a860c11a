"""Language ID by a linear-chain conditional random field over words.

A word's score for a language is a sum over hashed features: the word itself (lexicon), its first and
last letters (affixes) and its letter bigrams and trigrams. Transitions between the languages of
neighbouring words are learned too, so that forward-backward labels each word of code-switched text.
A chain is a sentence; one of more than ``CHAIN`` words goes on as a new chain. A document's language
is the one with the largest mean posterior over its words, and that mean is its score. Posteriors sum
to one for any text, so whether a text is in a learned language at all is told by two other measures:
the share of its letters in letter trigrams seen in training, and the share of letters in what is not space.

Training draws at most ``PER_LANG`` documents of each language (first in hashed order, at most
``TRAIN_BYTES`` each) outside the held-out fold and, of these, at most ``TRAIN_CHAINS`` sentences of each
language, evenly spread. Only documents are labelled, each with one language, so a share of the training
chains is spliced from sentences of two languages: it teaches switching. Every language that has a row
outside the held-out fold is learned; more than ``MAX_LANGUAGES`` are an error, as the weights are held whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

PER_LANG = 250
TRAIN_BYTES = 20_000
TRAIN_CHAINS = 2500
TRAIN_CELLS = 1 << 17
CHAIN = 64
HASHED = 1 << 16
ROUNDS = 40
RATE = 0.15
RIDGE = 1e-4
FOLDS, HELD_OUT = 3, 1
SURE, SLACK, COMMON = 0.9, 2 / 3, 0.02
UNKNOWN = "und"
BATCH_WORDS = 200_000
PIECE = 1 << 20
MAX_LANGUAGES = 500
#: Steps in which shares are counted; models without a language that a task keeps, and words of each.
STEPS = 4096
OTHERS, OTHER_WORDS = 4, 20_000

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_ENDS = (".", "!", "?", "\n")
_SPACE = re.compile(r"\s")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _hash(*codes: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(codes[0]), salt, np.uint64)
    for c in codes:
        h = (h + c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.int64) % HASHED


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-case words and the word that each belongs to, in the order of the words."""
    marked = [f"<{w}>" for w in words]
    size = np.array([len(m) for m in marked])
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(len(words)), size)
    left = end[owner] - np.arange(len(code))  # letters from here to the word's end
    two, three = np.flatnonzero(left >= 2), np.flatnonzero(left >= 3)
    at = np.arange(len(code)) - start[owner]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max(initial=1)) - 1, 0x100000001B3, np.uint64)]))
    whole = np.add.reduceat(code * power[at], start)
    parts = [(_hash(whole, salt=1), np.arange(len(words)))]
    for n in (2, 3, 4):
        has = np.flatnonzero(size >= n)
        parts.append((_hash(*[code[start[has] + i] for i in range(n)], salt=10 + n), has))
        parts.append((_hash(*[code[end[has] - 1 - i] for i in range(n)], salt=20 + n), has))
    parts.append((_hash(code[two], code[two + 1], salt=2), owner[two]))
    parts.append((_hash(code[three], code[three + 1], code[three + 2], salt=3), owner[three]))
    found, whose = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(whose, kind="stable")
    return found[order], whose[order]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter trigrams of ``<word>``, 21 bits a letter, and the word that each belongs to. Every word has one at least."""
    size = np.array([len(w) + 2 for w in words])
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    at = np.flatnonzero(np.cumsum(size)[owner] - np.arange(len(code)) >= 3)
    return (code[at] << np.uint64(42)) | (code[at + 1] << np.uint64(21)) | code[at + 2], owner[at]


def _common(texts: Iterator[set[str]]) -> np.ndarray:
    """Trigrams in two of the texts at least and in ``COMMON`` of them, so that a stray text does not make itself known."""
    found = [np.unique(trigrams(list(t))[0]) for t in texts if t]
    if not found:
        return np.zeros(0, np.uint64)
    code, n = np.unique(np.concatenate(found), return_counts=True)
    return code[n >= max(min(2, len(found)), COMMON * len(found))]


class Model:
    """Languages, feature weights (HASHED x L), transition weights (L x L) and start weights (L).

    ``grams`` are the trigrams of the training words in order; ``seen`` tells in which languages (N x L).
    """

    def __init__(self, langs: list[str], w: np.ndarray, trans: np.ndarray, start: np.ndarray, grams: np.ndarray, seen: np.ndarray):
        self.langs, self.w, self.trans, self.start, self.grams, self.seen = langs, w, trans, start, grams, seen

    def without(self, lang: str) -> Model:
        on = [y for y, x in enumerate(self.langs) if x != lang]
        return Model([self.langs[y] for y in on], self.w[:, on], self.trans[np.ix_(on, on)], self.start[on], self.grams, self.seen[:, on])

    def known(self, words: list[str]) -> np.ndarray:
        """Share of each word's trigrams seen in each language (n x L)."""
        code, owner = trigrams(words)
        if not len(self.grams):
            return np.zeros((len(words), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        hit = np.where((self.grams[at] == code)[:, None], self.seen[at], False).astype(np.float32)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        return np.add.reduceat(hit, first, axis=0) / np.bincount(owner)[:, None].astype(np.float32)


def posteriors(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Forward-backward over chains sorted by falling length. ``e`` is n x T x L, exponentiated.

    Returns word posteriors (n x T x L), expected transitions (L x L) if asked, and the log likelihood's normaliser.
    """
    n, steps, n_lang = e.shape
    active = [(lengths > t).sum() for t in range(steps)]
    a = np.zeros_like(e)
    scale = np.ones((n, steps), e.dtype)
    for t in range(steps):
        k = active[t]
        x = (start[None, :] if t == 0 else a[:k, t - 1] @ trans) * e[:k, t]
        s = x.sum(axis=1, keepdims=True)
        a[:k, t] = x / s
        scale[:k, t] = s[:, 0]
    g = a.copy()
    b = np.ones((n, n_lang), e.dtype)
    counts = np.zeros((n_lang, n_lang))
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        x = e[:k, t + 1] * b[:k] / scale[:k, t + 1][:, None]
        if pairs:
            counts += trans * (a[:k, t].T.astype(float) @ x)
        b[:k] = x @ trans.T
        g[:k, t] = a[:k, t] * b[:k]
    return g, counts, np.log(scale).sum()


def chains_of(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for tok in _TOKEN.findall(text.lower()):
        if tok in _ENDS or len(out[-1]) >= CHAIN:
            out.append([])
        if tok not in _ENDS:
            out[-1].append(tok)
    return [c for c in out if c]


def _blocks(lengths: np.ndarray, cells: int) -> list[int]:
    """Where to cut chains sorted by falling length, so that each block, filled up to its longest, has at most ``cells`` words or one chain."""
    cuts = [0]
    while cuts[-1] < len(lengths):
        cuts.append(min(len(lengths), cuts[-1] + max(1, cells // int(lengths[cuts[-1]]))))
    return cuts


def train(sample: pd.DataFrame, rounds: int = ROUNDS) -> Model | None:
    """A model from columns text and lang; None without labelled words.

    The driver trains: chains are held as numbers, and posteriors are made for ``TRAIN_CELLS`` of words by languages at a time.
    """
    langs = sorted(sample["lang"].unique())
    vocab: dict[str, int] = {}
    own: list[list[np.ndarray]] = []
    grams = []
    for lang in langs:
        # Texts are taken apart once to count their chains and once to keep some, so that words of one text at a time are held.
        texts = sample.loc[sample["lang"] == lang, "text"].tolist()
        grams.append(_common({w for c in chains_of(t) for w in c} for t in dict.fromkeys(texts)))
        n = sum(len(chains_of(t)) for t in texts)
        keep = set(np.linspace(0, n - 1, min(n, TRAIN_CHAINS)).astype(int).tolist()) if n else set()
        found = (c for t in texts for c in chains_of(t))
        own.append([np.array([vocab.setdefault(x, len(vocab)) for x in c], np.int32) for i, c in enumerate(found) if i in keep])
    if not any(own):
        return None
    data = [(c, np.full(len(c), y, np.int16)) for y, part in enumerate(own) for c in part]
    full = [[(c, y) for c in part] for y, part in enumerate(own) if part]
    if len(full) > 1:
        # Splice halves of sentences of two languages.
        for i in range(len(data) // 3):
            (w1, y1), (w2, y2) = (full[(i + j) % len(full)][(i * 7 + j) % len(full[(i + j) % len(full)])] for j in (0, 1 + i % (len(full) - 1)))
            w1, w2 = w1[: CHAIN // 2], w2[: CHAIN // 2]
            data.append((np.concatenate([w1, w2]), np.repeat(np.array([y1, y2], np.int16), [len(w1), len(w2)])))
    data.sort(key=lambda c: -len(c[0]))
    lengths = np.array([len(w) for w, _ in data])
    ids, gold = (np.concatenate([c[k] for c in data]) for k in (0, 1))
    ends = np.cumsum(lengths)
    del data, own, full
    flat, owner = features(list(vocab))
    n_lang, n_words = len(langs), len(vocab)
    total = len(ids)
    first = np.zeros(total, bool)
    first[ends - lengths] = True
    observed = np.bincount(gold.astype(np.int64) * n_words + ids, minlength=n_lang * n_words).reshape(n_lang, n_words)
    seen_pairs = np.bincount((gold[:-1].astype(np.int64) * n_lang + gold[1:])[~first[1:]], minlength=n_lang**2).reshape(n_lang, n_lang)
    seen_start = np.bincount(gold[first], minlength=n_lang)
    cuts = _blocks(lengths, TRAIN_CELLS // n_lang)
    params = [np.zeros((HASHED, n_lang)), np.zeros((n_lang, n_lang)), np.zeros(n_lang)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        w, tr, st = params
        word = np.stack([np.bincount(owner, w[flat, y], minlength=n_words) for y in range(n_lang)], axis=1)
        word = np.exp(word - word.max(axis=1, keepdims=True))
        expected, pairs, starts = np.zeros((n_lang, n_words)), np.zeros((n_lang, n_lang)), np.zeros(n_lang)
        for a, z in zip(cuts, cuts[1:], strict=False):
            on = np.arange(lengths[a]) < lengths[a:z, None]
            part = ids[ends[a] - lengths[a] : ends[z - 1]]
            e = np.ones((*on.shape, n_lang))
            e[on] = word[part]
            g, more, _ = posteriors(e, lengths[a:z], np.exp(tr), np.exp(st), True)
            pairs += more
            starts += g[:, 0].sum(axis=0)
            for y in range(n_lang):
                np.add.at(expected[y], part, g[..., y][on])
        d_word = (expected - observed) / total
        d_w = np.stack([np.bincount(flat, d_word[y][owner], minlength=HASHED) for y in range(n_lang)], axis=1)
        grads = [d_w + RIDGE * w / HASHED, (pairs - seen_pairs) / total, (starts - seen_start) / total]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            params[i] = params[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)
    w, tr, st = params
    every = np.unique(np.concatenate(grams))
    seen = np.stack([np.isin(every, g) for g in grams], axis=1)
    return Model(langs, w.astype(np.float32), np.exp(tr).astype(np.float32), np.exp(st).astype(np.float32), every, seen)


class Words(dict):
    """Word numbers, and their exponentiated scores in ``rows``: 0 ends a sentence, 1 is no word. Starts anew when full.

    ``known`` and ``letters`` have the share of seen trigrams by language and the length.
    """

    def __init__(self, model: Model, limit: int = 300_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(dict.fromkeys(_ENDS, 0))
        self.rows = np.ones((2, len(self.model.langs)), np.float32)
        self.known = np.zeros((2, len(self.model.langs)), np.float32)
        self.letters = np.zeros(2, np.int64)
        self.new: list[str] = []
        self.n = 2

    def __missing__(self, word: str) -> int:
        if not any(map(str.isalpha, word)):
            self[word] = 1
            return 1
        self.new.append(word)
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def score(self) -> None:
        """Fill ``rows`` up for the words that came up since the last time."""
        if self.new:
            flat, owner = features(self.new)
            s = np.add.reduceat(self.model.w[flat], np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)
            self.rows = np.vstack([self.rows, np.exp(np.maximum(s - s.max(axis=1, keepdims=True), -40))])
            self.known = np.vstack([self.known, self.model.known(self.new)])
            self.letters = np.concatenate([self.letters, [len(w) for w in self.new]])
            self.new = []


def label_words(ids: np.ndarray, doc: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word posteriors of a batch: ``ids`` and ``doc`` of all tokens in order. Returns those of real words and their documents."""
    model = words.model
    words.score()
    real = ids > 1
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] == 0) | (ids[:-1] == 0) | (doc[1:] != doc[:-1])
    part = np.cumsum(new)[real]
    ids, doc = ids[real], doc[real]
    if not len(ids):
        return np.zeros((0, len(model.langs)), np.float32), doc
    first = np.ones(len(ids), bool)
    first[1:] = part[1:] != part[:-1]
    at = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    first |= at % CHAIN == 0
    col = at % CHAIN
    chain = np.cumsum(first) - 1
    lengths = np.bincount(chain)
    order = np.argsort(-lengths, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    e = np.ones((len(lengths), int(lengths.max()), len(model.langs)), np.float32)
    row = place[chain]
    e[row, col] = words.rows[ids]
    g, _, _ = posteriors(e, lengths[order], model.trans, model.start)
    g = g[row, col]
    return g / g.sum(axis=1, keepdims=True), doc


def _pieces(text: str) -> Iterator[str]:
    """A long text cut before white space, which no word holds."""
    a = 0
    while len(text) - a > PIECE:
        m = _SPACE.search(text, a + PIECE)
        if m is None:
            break
        yield text[a : m.start()]
        a = m.start()
    yield text[a:]


def _word_ids(text: str | None, words: Words) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int64)
    return np.concatenate([np.array(list(map(words.__getitem__, _TOKEN.findall(p.lower()))), dtype=np.int64) for p in _pieces(text)])


def _cuts(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of at most BATCH_WORDS tokens that start where a chain does, so that cutting changes no label."""
    a = 0
    while len(ids) - a > BATCH_WORDS:
        own = ids[a : a + BATCH_WORDS]
        ends, real = np.flatnonzero(own == 0), np.flatnonzero(own > 1)
        full = len(real) // CHAIN * CHAIN
        z = a + (int(ends[-1]) + 1 if len(ends) else int(real[full - 1]) + 1 if full else BATCH_WORDS)
        yield ids[a:z]
        a = z
    yield ids[a:]


def predict(texts: list[str | None], words: Words) -> list[tuple[str, float, float, float]]:
    """(language, score, known, letters) of each text, in batches of about BATCH_WORDS words, inside long texts too.

    ``known`` is the share of its letters in trigrams seen in the languages that its words are labelled
    with, ``letters`` their share in all characters but spaces.
    """
    n_lang = len(words.model.langs)
    total = np.zeros((len(texts), n_lang))
    n, letters, known = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    ids: list[np.ndarray] = []
    of: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if ids:
            flat = np.concatenate(ids)
            g, doc = label_words(flat, np.repeat(of, [len(x) for x in ids]), words)
            flat = flat[flat > 1]
            long = words.letters[flat]
            n[:] += np.bincount(doc, minlength=len(texts))
            letters[:] += np.bincount(doc, long, minlength=len(texts))
            known[:] += np.bincount(doc, long * (g * words.known[flat]).sum(axis=1), minlength=len(texts))
            for y in range(n_lang):
                total[:, y] += np.bincount(doc, g[:, y], minlength=len(texts))
        ids.clear()
        of.clear()
        size = 0

    for k, text in enumerate(texts):
        for part in _cuts(_word_ids(text, words)):
            ids.append(part)
            of.append(k)
            size += len(part)
            if size >= BATCH_WORDS:
                flush()
        if words.n >= words.limit:
            flush()
            words.reset()
    flush()
    wide = np.array([sum(map(len, text.split())) if text else 0 for text in texts])
    mean = total / np.maximum(n, 1)[:, None]
    known, letters = known / np.maximum(letters, 1), np.minimum(letters / np.maximum(wide, 1), 1)
    return [
        (words.model.langs[b], float(min(max(mean[k, b], 0.0), 1.0)), float(known[k]), float(letters[k])) if n[k] else (UNKNOWN, 0.0, 0.0, 0.0)
        for k, b in enumerate(mean.argmax(axis=1))
    ]


def _sample(docs: DataFrame, fold: F.Column, per_lang: int, train_bytes: int, max_languages: int) -> pd.DataFrame | None:
    """The bounded sample of a fold. Documents without id, text or language are left out of it; of texts that share an id and language the one with the least hash counts."""
    narrow = docs.select("doc_id", "lang", F.octet_length("text").alias("n"))
    narrow = narrow.filter(F.col("n").between(1, train_bytes) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & fold)
    drawn = C.drawn(narrow, "lang", per_lang, max_languages)
    if drawn is None:
        return None
    sample = docs.select("doc_id", "text", "lang").join(F.broadcast(drawn), ["doc_id", "lang"]).filter(F.octet_length("text").between(1, train_bytes))  # at most max_languages * per_lang rows
    sample = sample.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return sample.select("doc_id", "lang", "one.text").toPandas().sort_values(["doc_id", "lang"], ignore_index=True)


def fit(docs: DataFrame, per_lang: int = PER_LANG, train_bytes: int = TRAIN_BYTES, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """Train on the bounded sample outside the held-out fold."""
    sample = _sample(docs, ~held_out(F.col("doc_id")), per_lang, train_bytes, max_languages)
    return None if sample is None else train(sample)


def floors(docs: DataFrame, model: Model, per_lang: int = PER_LANG) -> tuple[float, float]:
    """Least ``known`` and ``letters`` of a text in a learned language, from all labelled documents of the held-out fold.

    ``known`` is cut a quarter of the way from what ``SURE`` of these documents stay below when their own
    language is left out of the model to what as many reach with it, but at ``SLACK`` of the latter at most;
    ``letters`` at a third of what ``SURE`` of them reach. A language of more than ``per_lang`` documents counts as
    ``per_lang`` of them, so that a large one does not decide alone; values are counted in steps of 1 / ``STEPS``.
    Without held-out documents they are 0.5 and 0.25.
    """
    rows = docs.filter(held_out(F.col("doc_id")) & F.col("lang").isin(model.langs) & (F.octet_length("text") > 0)).select("lang", "text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, others = Words(model), {}
        for part in parts:
            out = []
            for lang, texts in part.groupby("lang")["text"]:
                texts = texts.tolist()
                found = [p for p in predict(texts, words) if p[0] != UNKNOWN]
                out += [(lang, kind, round(p[k] * STEPS)) for p in found for k, kind in ((2, "known"), (3, "letters"))]
                if len(model.langs) > 1:
                    if lang not in others:
                        if len(others) >= OTHERS:
                            others.pop(next(iter(others)))
                        others[lang] = Words(model.without(lang), OTHER_WORDS)
                    out += [(lang, "foreign", round(p[2] * STEPS)) for p in predict(texts, others[lang]) if p[0] != UNKNOWN]
            yield pd.DataFrame(out, columns=["lang", "kind", "step"])

    counts = rows.mapInPandas(run, "lang string, kind string, step int").groupBy("lang", "kind", "step").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang", "kind"))  # at most STEPS + 1 rows a language and kind
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / total)
    steps = counts.withColumn("w", F.col("n") * share).groupBy("kind", "step").agg(F.sum("w").alias("w")).toPandas()

    def reached(kind: str, q: float) -> float | None:
        own = steps[steps["kind"] == kind].sort_values("step")
        if own.empty:
            return None
        upto = own["w"].cumsum().to_numpy()
        return float(own["step"].to_numpy()[np.searchsorted(upto, q * upto[-1] * (1 - 1e-12))]) / STEPS

    known, letters = reached("known", 1 - SURE), reached("letters", 1 - SURE)
    if known is None:
        return 0.5, 0.25
    return min(0.25 * known + 0.75 * (reached("foreign", SURE) or 0.0), SLACK * known), letters / 3


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, lang, source, n_chars as far as there) with lang_pred, score, known and letters."""
    cols = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(model) if model else None
        for part in parts:
            got = predict(part["text"].tolist(), words) if words else [(UNKNOWN, 0.0, 0.0, 0.0)] * len(part)
            for k, name in enumerate(("lang_pred", "score", "known", "letters")):
                part[name] = [g[k] for g in got]
            yield part

    rows = docs.select(*cols)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, fields + ", lang_pred string, score double, known double, letters double")


def label_runs(docs: DataFrame, model: Model | None) -> DataFrame:
    """Code-switched text: one row per run of words of one language: doc_id, start, end (code points, end exclusive), lang, n_words, score.

    Every word of every whole text is in one run; ``score`` is the mean posterior of its words. A run ends where the
    language changes and, in texts of more than BATCH_WORDS words, where a batch does. Texts without letters have none.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(model) if model else None
        for part in parts:
            for doc, text in zip(part["doc_id"], part["text"], strict=True):
                found = list(_TOKEN.finditer(text)) if text and words else []
                ids = np.array([words[m.group().lower()] for m in found], dtype=np.int64)
                at, out = 0, []
                for own in _cuts(ids):
                    g, _ = label_words(own, np.zeros(len(own), np.int64), words) if words else (np.zeros((0, 1)), None)
                    real = [m for m, i in zip(found[at : at + len(own)], own, strict=True) if i > 1]
                    at += len(own)
                    lang = g.argmax(axis=1)
                    for s in np.split(np.arange(len(lang)), np.flatnonzero(np.diff(lang)) + 1):
                        if len(s):
                            y = lang[s[0]]
                            out.append((doc, real[s[0]].start(), real[s[-1]].end(), model.langs[y], len(s), float(g[s, y].mean())))
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "start", "end", "lang", "n_words", "score"])
                if words and words.n >= words.limit:
                    words.reset()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start int, end int, lang string, n_words int, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    A null text, an empty one and one without letters give ``und`` and 0; so does every text where no
    document has both a language and words to learn from. A null doc_id is kept, outside the held-out
    fold, and not learned from. Ties between languages go to the first by name. Extra columns are ignored.
    """
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(C.table(spark, sf_dir, "documents"))
