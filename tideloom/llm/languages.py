"""Problem 9: the language of documents and of the paragraphs of mixed ones.

String-kernel classification. A text is the set of its byte n-grams of length 1 to 3 (a blended spectrum with presence
weights), hashed to 2^18 features. Landmark paragraphs span the Nystroem approximation of the normalised kernel, and
one-versus-rest kernel ridge regression is solved in that space. As the kernel is linear in n-gram presence, the dual
coefficients of the landmarks are folded into one feature-by-language matrix once; batches of paragraphs are then scored
by one product of their sparse presence matrix with it.
The model is fitted on a bounded sample of labelled documents (SAMPLE per language), twice. Labels may be wrong, so two halves
of the sample judge each other some rounds first: paragraphs whose label the other half contradicts are dropped, and a label that fails on
most of its own paragraphs is no language. No language is left out for being rare. Everything else covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the fit: labelled documents a language, paragraphs a language and characters a paragraph, landmarks a language.
SAMPLE, PARAGRAPHS, LENGTH, LANDMARKS = 400, 400, 4000, 40
#: Rounds in which the halves of the sample judge each other.
ROUNDS = 3
BITS, RIDGE = 18, 1e-2
MASK = (1 << BITS) - 1
SLICE = 1 << 21

# Names and codes that the platform's own table lacks (bibliographic codes, spellings without accents).
NAMES = {
    "de": "ger", "fr": "fre francais", "es": "espanol castellano castilian", "nl": "dut flemish", "pt": "portugues", "cs": "cze", "ro": "rum", "el": "gre", "zh": "chi", "nb": "bokmål", "sv": "swe", "no": "nor norwegian norsk",
}


def codes_of_names(spark) -> dict[str, str]:
    """ISO 639-1 code of every code and name a language has: in English, in itself, in German and in French. From the platform's table of about 190 languages."""
    locale = spark._jvm.java.util.Locale
    out = {}
    spoken = [locale.ENGLISH, locale.GERMAN, locale.FRENCH]
    for code in locale.getISOLanguages():
        one = locale.forLanguageTag(code)
        if one.getLanguage() == code:
            names = [one.getISO3Language(), one.getDisplayLanguage(one), *[one.getDisplayLanguage(x) for x in spoken]]
            for name in (code, *(n.lower() for n in names)):
                out.setdefault(name, code)
    for code, names in NAMES.items():
        out.update(dict.fromkeys(names.split(), code))
    return out


def with_code(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with code, the ISO 639-1 code that its lang names in any usual notation, else null. Regions and scripts after the code don't
    count. The names, some thousand, are a fixed table and are joined by their hash."""
    table = F.broadcast(df.sparkSession.createDataFrame(sorted(names.items()), "_name string, code string"))
    head = F.regexp_replace(F.lower(F.trim("lang")), r"^([a-z]{2,3})[-_].*$", "$1")
    return df.join(table, head == F.col("_name"), "left").drop("_name")


def _classes() -> np.ndarray:
    """Byte to symbol: letters in lower case, bytes beyond ASCII as they are, all else a separator."""
    t = np.zeros(256, np.uint32)
    for c in range(26):
        t[ord("a") + c] = t[ord("A") + c] = c + 1
    t[128:] = np.arange(27, 155)
    return t


_CLASS = _classes()


def paragraph_bounds(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of paragraphs, document of each) of concatenated texts, cut at every first pair of line feeds as str.split would."""
    pair = np.flatnonzero((b[:-1] == 10) & (b[1:] == 10)) if len(b) > 1 else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, pair, "right") - 1
    pair = pair[np.searchsorted(offsets, pair + 1, "right") - 1 == doc]
    if len(pair):  # within a run of adjacent pairs every other one is a cut
        new = np.r_[True, np.diff(pair) > 1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(pair)), 0))
        pair = pair[(np.arange(len(pair)) - first) % 2 == 0]
    starts = np.sort(np.r_[offsets[:-1], pair + 2], kind="stable")
    # an empty document starts where the next one does: the document of a start is the last one for its own starts
    owner = np.searchsorted(offsets[:-1], starts, "right") - 1
    full = np.diff(offsets) > 0
    keep = full[owner]
    starts, owner = starts[keep], owner[keep]
    uniq = np.r_[True, np.diff(starts) > 0] if len(starts) else np.zeros(0, bool)
    return starts[uniq], owner[uniq]


def presence(b: np.ndarray, starts: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, index of each paragraph's first entry): the set of n-grams of each paragraph. Paragraphs without letters have none."""
    n = len(b)
    c = _CLASS[b]
    sizes = np.diff(np.r_[starts, n])
    par = np.repeat(np.arange(len(starts), dtype=np.uint64 if len(starts) >= 1 << (32 - bits) else np.uint32), sizes)
    p1, p2 = np.zeros_like(c), np.zeros_like(c)
    p1[1:], p2[2:] = c[:-1], c[:-2]
    p1[starts] = p2[starts] = 0
    second = starts[sizes > 1] + 1
    p2[second] = 0
    par <<= bits
    grams = []
    one = c > 0
    grams.append(par[one] | c[one])
    two = one & (p1 > 0)
    grams.append(par[two] | ((p1[two] * 157 + c[two] * 1543 + 977) & MASK))
    three = (c > 0).astype(np.uint8) + (p1 > 0) + (p2 > 0) >= 2
    grams.append(par[three] | ((p2[three] * 24593 + p1[three] * 12289 * 13 + c[three] * 769 + 50021) & MASK))
    keys = np.concatenate(grams)
    keys.sort()
    if len(keys):
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    firsts = np.searchsorted(keys, np.arange(len(starts) + 1).astype(keys.dtype) << keys.dtype.type(bits))
    return (keys & keys.dtype.type(MASK)).astype(np.int64), firsts


def scores(b: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph x language scores of the normalised kernel, set sizes)."""
    ids, firsts = presence(b, starts)
    size = np.diff(firsts)
    total = np.zeros((len(starts), weights.shape[1]), np.float32)
    some = size > 0
    if len(ids):
        total[some] = np.add.reduceat(weights[ids], firsts[:-1][some], axis=0)
    return total / np.sqrt(np.maximum(size, 1))[:, None], size


def _kernel_fit(rows: list[np.ndarray], y: np.ndarray, used: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """(feature x language) weights from the rows `used`: Nystroem landmarks of each language, then one-versus-rest ridge regression."""
    marks = np.concatenate([rng.permutation(used[y[used] == k])[:LANDMARKS] for k in range(n)])
    # only features that occur in landmarks enter the kernel; rows pass in blocks
    columns, inverse = np.unique(np.concatenate([rows[i] for i in marks]), return_inverse=True)
    dense = np.zeros((len(marks), len(columns)), np.float32)
    place = np.repeat(np.arange(len(marks)), [len(rows[i]) for i in marks])
    dense[place, inverse] = 1 / np.sqrt(np.array([max(1, len(rows[i])) for i in marks], np.float32))[place]
    where = np.full(MASK + 1, -1, np.int64)
    where[columns] = np.arange(len(columns))

    def kernel(some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(some), len(marks)))
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            x = np.zeros((len(part), len(columns)), np.float32)
            for r, i in enumerate(part):
                hit = where[rows[i]]
                x[r, hit[hit >= 0]] = 1 / np.sqrt(max(1, len(rows[i])))
            out[at : at + len(part)] = x @ dense.T
        return out

    knm, kmm = kernel(used), kernel(marks)
    val, vec = np.linalg.eigh((kmm + kmm.T) / 2)
    good = val > 1e-6
    root = vec[:, good] / np.sqrt(val[good])
    phi = knm @ root
    target = np.where(y[used][:, None] == np.arange(n), 1.0, -1.0)
    balance = np.sqrt(1 / np.bincount(y[used], minlength=n).clip(1))[y[used]][:, None]
    a = phi * balance
    w = np.linalg.solve(a.T @ a + RIDGE / n * np.eye(phi.shape[1]), a.T @ (target * balance))
    weights = np.zeros((MASK + 1, n), np.float32)
    weights[columns] = dense.T @ (root @ w).astype(np.float32)
    return weights


def fit(texts: list[str], labels: list[str], docs: list[int] | None = None, seed: int = 7) -> tuple[np.ndarray, list[str]]:
    """(feature x language matrix, language codes). docs tells which texts are of one document, each on its own if absent."""
    rng = np.random.default_rng(seed)
    codes = sorted(set(labels))
    y = np.array([codes.index(x) for x in labels])
    docs_ = np.arange(len(texts)) if docs is None else np.unique(np.array(docs), return_inverse=True)[1]
    raw = [t.encode("utf-8", "replace") for t in texts]
    b, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])[:-1]
    ids, firsts = presence(b, starts)
    rows = [ids[firsts[i] : firsts[i + 1]] for i in range(len(raw))]
    # halves of the documents of each language, or of the paragraphs where there is one document only
    half = np.zeros(len(rows), int)
    for k in range(len(codes)):
        own = np.flatnonzero(y == k)
        many = np.unique(docs_[own])
        half[own] = np.searchsorted(many, docs_[own]) % 2 if len(many) > 1 else np.arange(len(own)) % 2
    keep = np.ones(len(rows), bool)
    for _ in range(ROUNDS if len(codes) > 1 else 0):
        agreed = keep.copy()
        for side in (0, 1):
            train, held = np.flatnonzero((half == side) & keep), np.flatnonzero(half != side)
            have = np.unique(y[train])
            if len(have):
                w = _kernel_fit(rows, np.searchsorted(have, y), train, len(have), rng)
                agreed[held] = [have[w[rows[i]].sum(0).argmax()] == y[i] for i in held]
        keep = agreed
    sound = [k for k in range(len(codes)) if keep[y == k].mean() >= 0.5]
    if sound:
        keep &= np.isin(y, sound)
        codes, y = [codes[k] for k in sound], np.searchsorted(sound, y)
    else:  # nothing agrees: all labels stand
        keep[:] = True
    return _kernel_fit(rows, y, np.flatnonzero(keep), len(codes), rng), codes


def training_sample(df: DataFrame, names: dict[str, str]) -> tuple[list[str], list[str], list[int]]:
    """(paragraphs, codes, documents): of at most SAMPLE labelled documents a language, drawn by hash, at most PARAGRAPHS a language,
    drawn by hash, each of at most LENGTH characters. They are cut where the texts are, so what the driver gets is bounded."""
    labelled = with_code(df.where("doc_id IS NOT NULL").select("doc_id", "lang"), names).where("code IS NOT NULL").select("doc_id", "code")
    counts = {r.code: r.n for r in labelled.groupBy("code").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return [], [], []
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, 1.5 * SAMPLE / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = labelled.where(draw < F.try_element_at(share, F.col("code"))).distinct().withColumn("draw", draw)
    best = picked.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("draw", "doc_id"))).where(F.col("rank") <= SAMPLE)
    ids = {r.doc_id: r.code for r in best.select("doc_id", "code").collect()}  # at most SAMPLE a language
    picks = F.broadcast(df.sparkSession.createDataFrame(sorted(ids.items()), "doc_id long, code string"))
    chosen = df.where(F.col("doc_id").isin(list(ids))).select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.split(F.lower("text"), "\n\n")).alias("p")).where(F.length("p") >= 30)
    chosen = chosen.select("doc_id", F.substring("p", 1, LENGTH).alias("p")).join(picks, "doc_id")
    chosen = chosen.groupBy("code", "p").agg(F.min("doc_id").alias("doc_id"))  # copies mustn't vouch for each other
    w = Window.partitionBy("code").orderBy(F.xxhash64("p", "doc_id"), "p", "doc_id")
    rows = chosen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= PARAGRAPHS).orderBy("code", "rank").collect()
    return [r.p for r in rows], [r.code for r in rows], [r.doc_id for r in rows]


def _decide(score: np.ndarray, size: np.ndarray, owner: np.ndarray, n: int) -> tuple:
    """Per paragraph and document: language and confidence; weak paragraphs follow their document."""
    top2 = np.sort(np.partition(score, -2, axis=1)[:, -2:], axis=1) if score.shape[1] > 1 else np.repeat(score, 2, axis=1)
    lang, margin = score.argmax(1), top2[:, 1] - top2[:, 0]
    whole = np.zeros((n, score.shape[1]))
    np.add.at(whole, owner, score * size[:, None])
    doc = whole.argmax(1)
    weak = (margin < 0.12) | (size < 25)
    lang = np.where(weak, doc[owner], lang)
    return lang, 1 / (1 + np.exp(-6 * margin)), doc


def identify(df: DataFrame, weights: np.ndarray, codes: list[str], names: dict[str, str]) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, label, row): seg_no 0 for a text in one language, paragraphs from 1 for a mixed one; row tells rows of one id apart."""
    spark = df.sparkSession
    model = spark.sparkContext.broadcast((weights, codes))  # 2^18 features by the languages learned, of which the table has some 190

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = model.value
        lookup = np.array(known, object)
        for batch in batches:
            ids, labels, row = batch.column("doc_id"), batch.column("label"), batch.column("row")
            col = batch.column("text")
            col = pa.array(col.to_pylist(), pa.string()) if col.null_count or not pa.types.is_string(col.type) else col
            col = col.fill_null("") if col.null_count else col
            off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
            data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
            at = 0
            while at < len(col):
                end = max(at + 1, int(np.searchsorted(off, off[at] + SLICE)) - 1)
                end = min(end, len(col))
                o = off[at : end + 1] - off[at]
                b = data[off[at] : off[end]]
                starts, owner = paragraph_bounds(b, o)
                if len(starts):
                    score, size = scores(b, starts, w)
                    said, sure, doc = _decide(score, size, owner, end - at)
                    some = size > 0
                    lo, hi = np.full(end - at, 1 << 30), np.full(end - at, -1)
                    np.minimum.at(lo, owner[some], said[some])
                    np.maximum.at(hi, owner[some], said[some])
                    mixed = (lo != hi) & (hi >= 0)
                    first = np.searchsorted(owner, np.arange(end - at))
                    seg = np.arange(len(owner)) - first[owner] + 1
                    one = np.flatnonzero((lo == hi) & (hi >= 0))
                    conf = np.zeros(end - at)
                    np.add.at(conf, owner[some], sure[some])
                    conf /= np.maximum(1, np.bincount(owner[some], minlength=end - at))
                    par = np.flatnonzero(mixed[owner] & some)
                    docs = np.r_[one, owner[par]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(docs + at)), pa.array(np.r_[np.zeros(len(one), np.int32), seg[par].astype(np.int32)], pa.int32()), pa.array(lookup[np.r_[lo[one], said[par]]].tolist(), pa.string()),
                            pa.array(np.round(np.r_[conf[one], sure[par]], 4), pa.float64()), labels.take(pa.array(docs + at)), row.take(pa.array(docs + at)),
                        ],
                        ["doc_id", "seg_no", "lang", "confidence", "label", "row"],
                    )
                at = end

    rows = with_code(df.where("doc_id IS NOT NULL").select("doc_id", "text", "lang"), names)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.col("code").alias("label"), F.xxhash64("text", "lang").alias("row"))
    return rows.mapInArrow(each, "doc_id bigint, seg_no int, lang string, confidence double, label string, row bigint")


def language_segments(df: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, label) of every document with words; label is the delivered one as a code, null if it names none.

    Repeated rows count once; of rows with one id and other contents one whole row holds. Null texts and texts without letters give no row; without any usable label no language can be
    learned and the result is empty. A paragraph too short or too even to tell follows its document.
    """
    names = codes_of_names(df.sparkSession)
    texts, labels, docs = training_sample(df, names)
    if not texts:
        return df.sparkSession.createDataFrame([], "doc_id bigint, seg_no int, lang string, confidence double, label string")
    found = identify(df, *fit(texts, labels, docs), names).dropDuplicates(["doc_id", "seg_no", "row"])
    return found.withColumn("least", F.min("row").over(Window.partitionBy("doc_id"))).where("row = least").drop("row", "least")


def wrong_labels(segments: DataFrame) -> DataFrame:
    """The segments of documents whose label doesn't name the one language of the text."""
    return segments.where("seg_no > 0 OR label IS NULL OR label <> lang")
