"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.crf import leaf_blocks
from proofgrid.plans.storage import stored

GRAMS = 1 << 16
SAMPLE = 20_000  # labelled rows to which the text model is fitted, dealt evenly to the languages
LEAST = 1_000  # rows that a language has of them at least, however many languages there are
SLICE_CHARS = 1 << 20
TEMPER = 0.2  # overlapping n-grams are not independent
SMOOTH = 50.0  # how many rows of a parent a host's or a domain's own rows are weighed against
UNKNOWN = "und"
UNCODED = "mis"  # all languages outside of CODES
# Two-letter language codes, and three-letter codes of some of these languages.
CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en "
    "eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv "
    "ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne "
    "ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st "
    "su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
LONG_CODES = {
    "ara": "ar", "ces": "cs", "chi": "zh", "cze": "cs", "dan": "da", "deu": "de", "dut": "nl", "ell": "el", "eng": "en",
    "fin": "fi", "fra": "fr", "fre": "fr", "ger": "de", "gre": "el", "heb": "he", "hin": "hi", "hun": "hu", "ita": "it",
    "jpn": "ja", "kor": "ko", "nld": "nl", "nor": "no", "pol": "pl", "por": "pt", "ron": "ro", "rum": "ro", "rus": "ru",
    "spa": "es", "swe": "sv", "tur": "tr", "ukr": "uk", "zho": "zh",
}
# Suffixes of addresses that say something about the language.
SUFFIXES = "de at ch fr be es mx ar it pt br nl pl se no dk fi ru jp cn uk us ie au ca nz in com org net".split()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts with a space at both ends, and where each text's end."""
    parts = [b" %b " % t.encode() if t and not t.isspace() else b"" for t in texts]
    data = _LOWER[np.frombuffer(b"".join(parts), np.uint8)].astype(np.uint32)
    ends = np.cumsum([len(p) for p in parts])
    where = np.ones(len(data), bool)
    for back in (1, 2):
        at = ends - back
        where[at[at >= 0]] = False
    hashed = (data[:-2] * 2654435761 + data[1:-1] * 40503 * 257 + data[2:] * 97 * 65537) if len(data) > 2 else data[:0]
    keys = ((hashed >> 7) & np.uint32(GRAMS - 1)).astype(np.int64)
    keep = where[: len(keys)]
    upto = np.concatenate([[0], np.cumsum(keep)])
    return keys[keep], upto[np.minimum(ends, len(keys))] if len(parts) else ends


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        first, size = 0, 0
        texts: list[str] = []
        for row, value in enumerate(batch["text"]):
            texts.append(value.as_py() or "")
            size += len(texts[-1])
            if size >= SLICE_CHARS or row == batch.num_rows - 1:
                yield batch.slice(first, len(texts)), texts
                first, size, texts = row + 1, 0, []


def language_code(declared: Column) -> Column:
    """The code at the start of a language tag; ``UNCODED`` for others, null where there is none."""
    code = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    long = F.create_map(*[F.lit(x) for pair in LONG_CODES.items() for x in pair])
    short = F.coalesce(long[code], code)
    return F.when(F.coalesce(code, F.lit("")) == "", None).when(short.isin(CODES), short).otherwise(UNCODED)


def _even_share(sizes: list[int], sample: int) -> int:
    """The rows that a language may have, so that all together have ``sample``; not under ``LEAST``."""
    left = sample
    for i, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if n > share:
            return max(share, LEAST)
        left -= n
    return max(sizes)


def fit_text(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Every declared language and its log probabilities of n-grams, from rows chosen by hash.

    A language with more labelled rows than its share of ``sample`` is fitted to about as many rows as its share,
    one with fewer to all of them. ``rows``: id, text, declared. The last language is unknown: all n-grams alike.
    Languages are ``CODES`` and ``UNCODED``, so what the driver gathers and sends out has a bound (a table of at most
    186 times ``GRAMS`` floats, 49 MB) whatever is declared.
    """
    labelled = rows.filter("declared is not null")
    sizes = dict(labelled.groupBy("declared").count().collect())
    if not sizes:
        return [UNKNOWN], np.full((1, GRAMS), -np.log(GRAMS), np.float32)
    share = _even_share(list(sizes.values()), sample)
    limits = [(name, -(1 << 63) + ((1 << 64) - 1) * min(share, n) // n) for name, n in sizes.items()]
    limits = rows.sparkSession.createDataFrame(limits, "declared string, upto long")
    chosen = labelled.join(F.broadcast(limits), "declared").filter(F.xxhash64("id", F.lit(11)) <= F.col("upto"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, texts in _slices(batches):
            names = np.array(batch["declared"].to_pylist(), object)
            for name in set(names.tolist()):
                keys, _ = _grams([t for t, own in zip(texts, names == name, strict=True) if own])
                sums[name] = sums.get(name, 0) + np.bincount(keys, minlength=GRAMS)
        for name, counts in sums.items():
            there = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "declared": pa.array([name] * len(there), pa.string()), "gram": pa.array(there.astype(np.int32)),
                "n": pa.array(counts[there]),
            })

    def counted(some: DataFrame) -> pa.Table:
        grams = some.select("text", "declared").mapInArrow(run, "declared string, gram int, n long")
        return grams.groupBy("declared", "gram").agg(F.sum("n").alias("n")).toArrow()

    found = counted(chosen)
    # All chosen rows of a language may be empty or, with repeated ids, none may be chosen.
    missing = sorted(set(sizes) - set(found["declared"].unique().to_pylist()))
    if missing and share < max(sizes[name] for name in missing):
        found = pa.concat_tables([found, counted(labelled.filter(F.col("declared").isin(missing)))])
    found = found.to_pandas()
    names = sorted(found["declared"].unique())
    table = np.zeros((len(names) + 1, GRAMS))
    for i, name in enumerate(names):
        own = found[found["declared"] == name]
        table[i, own["gram"]] = own["n"]
        table[i] = np.log((table[i] + 0.1) / (table[i].sum() + 0.1 * GRAMS))
    table[-1] = -np.log(GRAMS)
    return [*names, UNKNOWN], table.astype(np.float32)


def _scored(rows: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """id, key, host, domain, suffix, declared, n_grams and scores: the text's log likelihood per language."""
    held = rows.sparkSession.sparkContext.broadcast(table)
    kept = ["id", "key", "host", "domain", "suffix", "declared"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches):
            keys, ends = _grams(texts)
            scores = np.empty((len(texts), len(held.value)))
            for i, row in enumerate(held.value):
                sums = np.concatenate([[0.0], np.cumsum(row[keys], dtype=np.float64)])
                scores[:, i] = np.diff(sums[ends], prepend=0)
            yield pa.RecordBatch.from_arrays(
                [*(batch[name] for name in kept), pa.array(np.diff(ends, prepend=0).astype(np.int64)),
                 pa.array(list(scores), pa.list_(pa.float64()))],
                [*kept, "n_grams", "scores"],
            )

    kinds = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in kept)
    return rows.select(*kept, "text").mapInArrow(run, f"{kinds}, n_grams long, scores array<double>")


def _best(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def identify(
    df: DataFrame, row_id: str, text: Column, declared: Column, address: Column, sample: int = SAMPLE
) -> DataFrame:
    """id, key (hash of the text), lang, probability, text_lang, kept of every row.

    Evidence that is missing (null, a declared language or suffix that is not known) adds nothing. A text without
    words has no likelihood and is rejected, as is one whose most probable language is unknown. Priors of a
    host shrink towards its domain's, those of a domain towards all rows'; they count the languages that the texts
    alone suggest, over all rows. A declared language outside of ``CODES`` counts as ``UNCODED``. Without a labelled row no
    language is known. Of equally probable languages the first in alphabetical order is taken. Texts are read whole.
    Repeated rows stay; other columns are not read.
    """
    host = F.lower(F.coalesce(F.regexp_extract(address, r"^(?:\w+://)?([^/?#:]+)", 1), F.lit("")))
    labels = F.split(host, r"\.")
    whole = F.coalesce(text, F.lit(""))
    suffix = F.when(F.size(labels) > 1, F.element_at(labels, -1))
    rows = df.select(
        F.col(row_id).alias("id"), F.xxhash64(whole).alias("key"), host.alias("host"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
        F.when(suffix.isin(SUFFIXES), suffix).alias("suffix"),
        language_code(declared).alias("declared"), whole.alias("text"),
    )
    names, table = fit_text(rows, sample)
    known = len(names) - 1
    if not known:
        nothing = F.lit(None)
        return rows.select(
            "id", "key", F.lit(UNKNOWN).alias("lang"), nothing.cast("double").alias("probability"),
            nothing.cast("string").alias("text_lang"), F.lit(False).alias("kept"),
        )
    scored = stored(_scored(rows, names, table), "language-scores")
    guess = F.when(F.col("n_grams") > 0, _best(F.col("scores")))
    guessed = scored.withColumn("guess", guess)
    evidence = {
        name: _likelihoods(guessed, name, values, len(names))
        for name, values in (("declared", names[:-1]), ("suffix", SUFFIXES))
    }
    each = [F.count_if(F.col("guess") == i).alias(f"n{i}") for i in range(known)]
    add = lambda: [F.sum(f"n{i}").alias(f"n{i}") for i in range(known)]
    hosts = stored(guessed.groupBy("host", "domain").agg(*each), "language-hosts")
    domains = hosts.groupBy("domain").agg(*add())
    total = hosts.agg(*add()).first() if known else []
    counts = np.array([n or 0 for n in total], float)
    base = (counts + 1) / (counts.sum() + len(counts)) if known else counts
    smooth = lambda own, parent: (own + SMOOTH * parent)
    n_all = sum((F.col(f"n{i}") for i in range(known)), F.lit(0.0)) + SMOOTH
    upper = domains.select(
        "domain", *[(smooth(F.col(f"n{i}"), float(base[i])) / n_all).alias(f"p{i}") for i in range(known)]
    )
    priors = hosts.join(upper, "domain").select(
        "host", F.array(*[F.log(smooth(F.col(f"n{i}"), F.col(f"p{i}")) / n_all) for i in range(known)],
                        F.lit(float(np.log(1e-6)))).alias("prior"),
    )
    fused = scored.join(priors, "host")
    total_score = lambda *parts: F.transform("scores", lambda s, i: sum((F.get(p, i) for p in parts), s * TEMPER))
    parts = ["prior"]
    for name, found in evidence.items():
        pairs = [F.lit(x) for key, logs in found.items() for x in (key, logs)]
        flat = F.array(*[F.lit(0.0)] * len(names))
        column = flat
        for key, logs in found.items():
            column = F.when(F.col(name) == key, F.array(*[F.lit(float(v)) for v in logs])).otherwise(column)
        fused = fused.withColumn(f"_{name}", column if pairs else flat)
        parts.append(f"_{name}")
    fused = fused.withColumn("_sum", total_score(*parts)).withColumn("_at", _best(F.col("_sum")))
    spread = F.aggregate("_sum", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max("_sum")))
    listed = F.array(*[F.lit(n) for n in names])
    lang = F.when(F.col("n_grams") > 0, F.get(listed, F.col("_at"))).otherwise(UNKNOWN)
    return fused.select(
        "id", "key", lang.alias("lang"), F.when(F.col("n_grams") > 0, 1 / spread).alias("probability"),
        F.when(F.col("n_grams") > 0, F.get(listed, _best(F.col("scores")))).alias("text_lang"),
        (lang != UNKNOWN).alias("kept"),
    )


def _likelihoods(guessed: DataFrame, name: str, known: list[str], languages: int) -> dict[str, np.ndarray]:
    """log P(evidence | language) for the ``known`` values that have rows; counts of others are not gathered."""
    found = (
        guessed.filter(F.col(name).isin(known) & F.col("guess").isNotNull()).groupBy(name, "guess").count().collect()
    )
    values = sorted({r[0] for r in found})
    counts = np.full((len(values), languages), 1.0)
    for value, guess, n in found:
        counts[values.index(value), guess] += n
    logs = np.log(counts / counts.sum(0))
    logs[:, -1] = -np.log(max(1, len(values)))
    return dict(zip(values, logs, strict=True))


def documents(df: DataFrame) -> DataFrame:
    return identify(df, "doc_id", F.col("text"), F.col("lang"), F.col("source"))


def query(df: DataFrame) -> DataFrame:
    return documents(df).select(F.col("id").alias("doc_id"), "lang", "probability", "text_lang", "kept")


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, url, declared and text of raw pages: the root's lang attribute and the text of all blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = frozenset()
        for batch in batches:
            texts = ["\n".join(b.text for b in leaf_blocks(v.as_py() or "", none)) for v in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], batch["declared"], pa.array(texts, pa.string())],
                ["page_id", "url", "declared", "text"],
            )

    declared = F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    rows = pages.select("page_id", "url", declared.alias("declared"), "html")
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("page_id", "url", "declared"))
    return rows.mapInArrow(run, f"{kinds}, text string")


def query_pages(df: DataFrame) -> DataFrame:
    """The same for raw pages: the markup's lang attribute, the address, and the text of the page's blocks."""
    rows = stored(page_rows(df), "page-texts")
    found = identify(rows, "page_id", F.col("text"), F.col("declared"), F.col("url"))
    return found.select(F.col("id").alias("page_id"), "lang", "probability", "text_lang", "kept")


def keep(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in a known language, with its own columns."""
    rejected = documents(df).filter("not kept").select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct()
    rejected = stored(rejected, "language-rejected")  # its size is then known: few rows are broadcast
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return df.join(rejected, F.col("doc_id").eqNullSafe(F.col("_id")) & (key == F.col("_key")), "left_anti")
