"""Problem 9: the languages of texts and of the segments of mixed texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane.session import cut

# Three-letter codes of libraries and names that labels use beside those that the JVM's locales know.
OTHER_NOTATIONS = {
    "de": "ger", "fr": "fre", "nl": "dut flemish", "cs": "cze", "sk": "slo", "ro": "rum", "el": "gre", "eu": "baq", "fa": "per farsi", "zh": "chi", "hy": "arm", "is": "ice", "mk": "mac", "ms": "may",
    "my": "bur", "cy": "wel", "sq": "alb", "ka": "geo", "mi": "mao", "bo": "tib", "es": "castellano castilian", "no": "nob nno nb nn", "he": "iw", "id": "in", "yi": "ji",
}
#: Locales whose names of languages are read.
NAMING = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "sv", "da", "ru", "tr")


def language_table(spark: SparkSession) -> dict[str, str]:
    """Lower-case notation to two-letter code: codes of two and three letters and names, in ``NAMING`` and in the language itself."""
    locale = spark.sparkContext._jvm.java.util.Locale
    into = [locale.forLanguageTag(x) for x in NAMING]
    out: dict[str, str] = {}
    renamed = {"iw": "he", "in": "id", "ji": "yi", "nb": "no", "nn": "no"}
    for raw in locale.getISOLanguages():
        own = locale.forLanguageTag(raw)
        code = renamed.get(raw, raw)
        for name in [raw, code, own.getISO3Language(), *[own.getDisplayLanguage(x) for x in (*into, own)]]:
            if name:
                out.setdefault(name.lower(), code)
    for code, names in OTHER_NOTATIONS.items():
        out |= dict.fromkeys(names.split(), code)
    return out


_SPLIT = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
# codes, addresses, markup, and words that change between small and capital letters again and again, as encoded data does
_SKIP = re.compile(r"https?://\S+|<[^>]*>|\S*@\S+|\S*\d\S*|\S*[=/\\{}\[\]|#+_]\S*|[^\W\d_]*[a-z][A-Z]+[a-z]+[A-Z][^\W\d_]*")


def label_code(label: str | None, table: dict[str, str]) -> str | None:
    """The two-letter code that a label means, in whatever notation; null if it names no language."""
    if label is None:
        return None
    t = label.strip().lower()
    return table.get(t) or table.get(re.split(r"[-_ (.]", t)[0])


def units(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, words)`` of the sentences of a text: words in lower case between blanks, names and codes left out."""
    out, at = [], 0
    ends = [(m.start(), m.end()) for m in _SPLIT.finditer(text)] + [(len(text), len(text))]
    for a, b in ends:
        if a > at:
            s = unicodedata.normalize("NFC", text[at:a])
            words, first = [], True
            loud = s.isupper()
            for w in _WORD.findall(_SKIP.sub(" ", s)):
                # capitalised words within a sentence are names, mostly
                if first or loud or not w[0].isupper():
                    words.append(w.lower())
                first = False
            out.append((at, a, " ".join(words)))
        at = b
    return out


def gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, starts)``: the three-letter n-grams of texts as numbers of 63 bits, and where each text's begin.

    Each text stands between blanks; one without letters has none, so its start is that of the next.
    """
    sizes = np.array([len(w) + 2 if w else 0 for w in words], dtype=np.int64)
    text = "".join([f" {w} " for w in words if w])
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    codes = c[:-2] | c[1:-1] << 21 | c[2:] << 42
    ends = np.cumsum(sizes[sizes > 0])
    keep = np.ones(len(codes), dtype=bool)
    for back in (1, 2):  # n-grams that would reach into the next text
        at = ends[:-1] - back
        keep[at] = False
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes - 2, 0))])[:-1]
    return codes[keep], starts


#: Unseen n-grams whose products a worker keeps; further ones are computed anew each time, with the same result.
KEPT = 400_000


class Profiles:
    """Hyperdimensional profiles: a letter is a random vector of signs; an n-gram binds its letters, permuted by their
    place; a language bundles its n-grams. A text's bundle is never built: its product with a prototype is the sum of its n-grams'
    products, and its length follows from the counts, as different n-grams' vectors are orthogonal but for chance."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], dim: int = 4096, seed: int = 7):
        self.dim, self.seed = dim, seed
        self.languages = sorted(counts)
        self.letters: dict[int, np.ndarray] = {}
        self.codes = np.unique(np.concatenate([c for c, _ in counts.values()] or [np.zeros(0, np.int64)]))
        weight = np.zeros((len(self.languages), len(self.codes)), dtype=np.float32)
        for k, lang in enumerate(self.languages):
            codes, n = counts[lang]
            weight[k, np.searchsorted(self.codes, codes)] = np.log1p(1e5 * n / max(1, n.sum()))
        if len(weight):
            weight -= weight.mean(0, keepdims=True)
        proto = np.zeros((len(self.languages), dim), dtype=np.float32)
        for at in range(0, len(self.codes), 2000):
            proto += weight[:, at : at + 2000] @ self.bind(self.codes[at : at + 2000])
        norm = np.linalg.norm(proto, axis=1, keepdims=True)
        self.proto = proto / np.where(norm == 0, 1, norm)
        self.rows = self.products(self.codes)

    def letter(self, c: int) -> np.ndarray:
        v = self.letters.get(c)
        if v is None:
            v = self.letters[c] = np.random.default_rng([self.seed, c]).choice(np.array([-1, 1], dtype=np.int8), self.dim)
        return v

    def bind(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.dim), dtype=np.int8)
        for place in range(3):
            c = codes >> (21 * place) & ((1 << 21) - 1)
            letters, back = np.unique(c, return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(x)), place) for x in letters])[back] if len(letters) else out
        return out.astype(np.float32)

    def products(self, codes: np.ndarray) -> np.ndarray:
        """The cosines of single n-grams with the prototypes."""
        parts = [self.bind(codes[at : at + 2000]) @ self.proto.T for at in range(0, len(codes), 2000)]
        return np.concatenate(parts or [np.zeros((0, len(self.languages)), np.float32)]) / np.float32(np.sqrt(self.dim))

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        new = codes[self.codes[at] != codes] if len(self.codes) else codes
        if not len(new):
            return self.rows[at]
        products = self.products(new)
        if len(self.codes) + len(new) <= KEPT:
            order = np.argsort(every := np.concatenate([self.codes, new]))
            self.codes, self.rows = every[order], np.concatenate([self.rows, products])[order]
            return self.rows[np.searchsorted(self.codes, codes)]
        out = np.zeros((len(codes), len(self.languages)), dtype=np.float32)
        seen = self.codes[at] == codes
        out[seen], out[~seen] = self.rows[at[seen]], products
        return out

    def cosines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(cosine, length)`` of texts: with each prototype, and the length of the bundle in n-grams."""
        codes, starts = gram_codes(words)
        kinds, back = np.unique(codes, return_inverse=True)
        sums, lengths = np.zeros((len(words), len(self.languages)), dtype=np.float32), np.zeros(len(words))
        has = np.array([bool(w) for w in words], dtype=bool)
        if len(codes):
            sums[has] = np.add.reduceat(self.lookup(kinds)[back], starts[has], axis=0)
            owner = np.repeat(np.flatnonzero(has), np.diff(np.append(starts[has], len(codes))))
            pairs, times = np.unique(owner * len(kinds) + back, return_counts=True)
            lengths = np.sqrt(np.bincount(pairs // len(kinds), times.astype(float) ** 2, len(words)))
        return sums / np.maximum(lengths, 1)[:, None], lengths


def segments(found: list[tuple[int, int, str]], cosine: np.ndarray, length: np.ndarray, languages: list[str], switch: float) -> list[tuple[int, int, str, float]]:
    """``(start, end, lang, confidence)``: the longest runs of sentences in one language.

    The likeliest sequence of languages over the sentences: a sentence counts with its cosines times its length, a change costs ``switch``. Sentences without words
    belong to the run around them. ``confidence`` is the share of the language in the exponentiated cosines of the run.
    """
    at = [k for k, u in enumerate(found) if u[2]]
    if not at or not languages:
        return []
    e = cosine[at] * length[at][:, None]
    best, back = e[0].copy(), []
    for x in e[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - switch) + x
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    out, k = [], 0
    while k < len(path):
        j = k
        while j < len(path) and path[j] == path[k]:
            j += 1
        run = e[k:j].sum(0) / np.sqrt((length[at[k:j]] ** 2).sum())
        p = np.exp(12.0 * (run - run.max()))
        out.append((found[at[k]][0], found[at[j - 1]][1], languages[path[k]], float(p[path[k]] / p.sum())))
        k = j
    return out


#: Texts that are judged together, by their number and by their characters.
TEXTS, CHARS = 256, 1_000_000


def _judged(texts: Iterator[tuple], profiles: Profiles, switch: float) -> Iterator[tuple]:
    """``(row, sentences, segments)`` of ``(row, text)``, several texts at once; a text is never cut."""

    def flush(part):
        cosine, length = profiles.cosines([u[2] for _, found in part for u in found])
        at = 0
        for row, found in part:
            end = at + len(found)
            yield row, found, segments(found, cosine[at:end], length[at:end], profiles.languages, switch)
            at = end

    part, chars = [], 0
    for row, text in texts:
        part.append((row, units(text)))
        chars += len(text)
        if len(part) >= TEXTS or chars >= CHARS:
            yield from flush(part)
            part, chars = [], 0
    if part:
        yield from flush(part)


def _count_batches(profiles: Profiles | None, switch: float = 0.5):
    """Counts of n-grams by language: the label's, or the one that ``profiles`` finds for a segment; then also how often a label agrees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, list] = {}
        agree: dict[tuple, int] = {}
        for b in batches:
            if profiles is None:
                for lang, text in zip(b["lang"], b["text"]):
                    words.setdefault(lang, []).extend(w for _, _, w in units(text) if w)
                continue
            for lang, found, runs in _judged(zip(b["lang"], b["text"]), profiles, switch):
                size: dict[str, int] = {}
                for a, e, at, _ in runs:
                    own = [w for x, y, w in found if w and x >= a and y <= e]
                    words.setdefault(at, []).extend(own)
                    size[at] = size.get(at, 0) + sum(map(len, own))
                if size:
                    key = (lang, max(sorted(size), key=size.get))
                    agree[key] = agree.get(key, 0) + 1
        out = []
        for lang, w in words.items():
            codes, n = np.unique(gram_codes(w)[0], return_counts=True)
            out.append(pd.DataFrame({"lang": lang, "judged": None, "gram": codes, "n": n}))
        out.append(pd.DataFrame([(a, j, -1, n) for (a, j), n in agree.items()], columns=["lang", "judged", "gram", "n"]))
        yield pd.concat(out)

    return run


#: A label is a language's name if so many of the texts under it are judged to be in it.
CONFIRMED = 0.2


def train(documents: DataFrame, per_label: int = 400, least: int = 5, dim: int = 4096) -> Profiles:
    """Prototypes from the labels as delivered, on about ``per_label`` documents a label, chosen by hash.

    Labels are read in any notation. The first prototypes, one for each label on ``least`` documents (fewer in tables of
    under ``20 * least``), find the segments of the sample, and the segments' n-grams make the second ones, which takes wrong
    labels and mixed texts out. A label that under ``CONFIRMED`` of its own texts are judged to be in - its texts are in
    other languages - has no second prototype. What reaches the driver are the n-gram counts of the sample.
    """
    spark = documents.sparkSession
    table = language_table(spark)
    known = F.broadcast(spark.createDataFrame(sorted(table.items()), "name string, code string"))  # as many as the locales have
    t = F.lower(F.trim("lang"))
    labels = documents.select("lang").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    first_word = F.split(t, r"[-_ (.]")[0]
    codes = labels.join(known.withColumnsRenamed({"name": "n1", "code": "c1"}), t == F.col("n1"), "left").join(known.withColumnsRenamed({"name": "n2", "code": "c2"}), first_word == F.col("n2"), "left")
    codes = codes.select("lang", F.coalesce("c1", "c2").alias("code")).where("code is not null")
    labelled = documents.where("text is not null").select("doc_id", "text", "lang").join(codes, "lang").select("doc_id", "text", F.col("code").alias("lang"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a language
    kept = {k: n for k, n in sizes.items() if n >= min(least, sum(sizes.values()) // 20)}
    if not kept:
        return Profiles({}, dim)
    share = F.create_map(*[x for k, n in kept.items() for x in (F.lit(k), F.lit(min(1.0, per_label / n)))])
    sample = labelled.where(F.col("lang").isin(list(kept))).where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))
    sample = cut(sample)

    def collect(profiles: Profiles | None) -> tuple[dict, dict]:
        counted = sample.mapInPandas(_count_batches(profiles), "lang string, judged string, gram bigint, n bigint").groupBy("lang", "judged", "gram").agg(F.sum("n").alias("n")).toPandas()
        grams = counted[counted.gram >= 0].sort_values(["lang", "gram"])
        return {k: (g.gram.to_numpy(np.int64), g.n.to_numpy(np.int64)) for k, g in grams.groupby("lang")}, {(r.lang, r.judged): r.n for r in counted[counted.gram < 0].itertuples()}

    first, _ = collect(None)
    second, judged = collect(Profiles(first, dim))
    of = {k: sum(n for (a, _), n in judged.items() if a == k) for k in kept}
    sure = [k for k in second if judged.get((k, k), 0) >= CONFIRMED * of.get(k, 0) > 0]
    return Profiles({k: second[k] for k in sure or second}, dim)


def detect(documents: DataFrame, switch: float = 0.5, per_label: int = 400) -> DataFrame:
    """``doc_id, seg_no, lang, confidence, start_pos, end_pos, label_code, n_languages`` of every segment.

    Texts are cut into sentences at line ends and after . ! ?; names, codes, addresses and markup are left out of
    the profile. Confidence is the share of the segment's language in the exponentiated cosines. Null and empty texts
    and texts without words have no segments; long texts are read whole; repeated rows give repeated rows. Without any
    label that names a language there are no prototypes and no segments.
    ``start_pos`` counts code points from 1. Bind, bundle and cosine are those of ``Profiles``.
    """
    table = language_table(documents.sparkSession)
    profiles = train(documents, per_label)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for (doc, label), _, got in _judged((((d, x), t) for d, x, t in zip(b["doc_id"], b["lang"], b["text"])), profiles, switch):
                many = len({x[2] for x in got})
                code = label_code(label, table)
                out += [(doc, k, lang, c, a + 1, e + 1, code, many) for k, (a, e, lang, c) in enumerate(got, 1)]
            yield pd.DataFrame(out, columns=["doc_id", "seg_no", "lang", "confidence", "start_pos", "end_pos", "label_code", "n_languages"])

    rows = documents.where("text is not null and text != ''").select("doc_id", "text", "lang")
    return rows.mapInPandas(run, "doc_id bigint, seg_no bigint, lang string, confidence double, start_pos bigint, end_pos bigint, label_code string, n_languages int")


def found_segments(documents: DataFrame) -> DataFrame:
    """``doc_id, seg_no, lang`` of the documents whose label is missing, names no language or another one, or whose text has several."""
    d = detect(documents)
    return d.where(F.col("label_code").isNull() | (F.col("n_languages") > 1) | (F.col("label_code") != F.col("lang"))).select("doc_id", "seg_no", "lang")
