"""Column profiling (J1-J8): types, frequencies, histograms, target/task types.

Everything is an aggregate; only bounded results (a few numbers per column,
at most ``topn`` values, at most the number of bins) are ever materialised.
Exact quartiles of all columns come from a few passes that narrow brackets of
values around the needed ranks, without a sort or a single-task buffer.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TS = (T.TimestampType, T.TimestampNTZType, T.DateType)


# ------------------------------------------------------------------ J2
def resolve_type(dtype: T.DataType, format_as: str | None = None) -> str:
    """Type name of a column: ``str``, ``datetime``, ``bool``, ``int``, ``float``.

    A per-column override (``str``/``datetime``) wins, as in the reference.
    """
    if format_as in ("str", "string"):
        return "str"
    if format_as in ("datetime",):
        return "datetime"
    if isinstance(dtype, _TS):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "str"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, T.FractionalType):
        return "float"
    return "str"


def resolve_types(schema: T.StructType, formats: dict | None = None) -> dict[str, str]:
    formats = formats or {}
    return {f.name: resolve_type(f.dataType, formats.get(f.name)) for f in schema.fields}


# ------------------------------------------------------------------ J3 / F3
def freq(df: DataFrame, col: str, topn: int = 5) -> DataFrame:
    """Value shares of ALL rows (nulls count in the denominator, are not listed),
    rounded to 4 places; with more than ``topn`` distinct values the top
    ``topn-1`` are kept plus ``other (<distinct - (topn-1)>)`` = 1 - their sum.

    Returns ``(key string, share double, rank int)``; ties by value.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    g = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("key")) \
        .agg(F.count(F.lit(1)).alias("n"))
    nd = g.select(F.count(F.lit(1))).scalar()
    top = g.orderBy(F.col("n").desc(), F.col("key")).limit(topn)
    top = top.withColumn("share", F.round(F.col("n") / total, 4))
    from pyspark.sql import Window
    w = Window.orderBy(F.col("n").desc(), F.col("key"))        # over <= topn rows
    top = top.withColumn("rank", F.row_number().over(w))
    keep = top.filter((nd <= topn) | (F.col("rank") <= topn - 1)).select("key", "share", "rank")
    other = top.filter(F.col("rank") <= topn - 1).agg(
        F.concat(F.lit("other ("), (nd - (topn - 1)).cast("string"), F.lit(")")).alias("key"),
        (F.lit(1.0) - F.sum("share")).alias("share"),
        F.lit(0).alias("rank")).filter(nd > topn)
    return keep.unionByName(other)


# ------------------------------------------------------------------ exact quantiles
#: Values of a bracket that are fetched and sorted at once, and the accuracy of a bracket's sketch.
BRACKET = 2000
ACCURACY = 2000


def exact_quantiles_of(df: DataFrame, probs: dict[str, list[float]]) -> dict[str, tuple[list[float], dict]]:
    """Linear-interpolated exact quantiles (numpy's default) of several numeric
    columns together, without sorting any of them.

    Every rank that is wanted has a bracket of values around it. A pass over
    the table narrows all brackets of all columns by a mergeable sketch and the
    next counts what lies before and inside them; each pair of passes leaves
    about ``2 / ACCURACY`` of a bracket. A bracket of at most ``BRACKET`` values,
    or of one value, gives its rank's value. Returns (quantiles, stats) by
    column, stats with n, min, max. Nulls and NaN are ignored.
    """
    cols = list(probs)
    v = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in cols}
    x = df.select(*[v[c].alias(f"v{i}") for i, c in enumerate(cols)])
    st = x.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(len(cols)) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    stats = {c: {"n": st[f"n{i}"], "min": st[f"lo{i}"], "max": st[f"hi{i}"]} for i, c in enumerate(cols)}
    # (column, rank) -> [low, high, values before low, values from low to high]
    open_ = {(i, r): [st[f"lo{i}"], st[f"hi{i}"], 0, st[f"n{i}"]] for i, c in enumerate(cols) if stats[c]["n"]
             for p in probs[c] for r in (math.floor(p * (stats[c]["n"] - 1)), math.ceil(p * (stats[c]["n"] - 1)))}
    done: dict[tuple[int, int], float] = {}

    def inside(i: int, b: list) -> object:
        return F.when(F.col(f"v{i}").between(b[0], b[1]), F.col(f"v{i}"))

    while open_:
        done.update((k, b[0]) for k, b in open_.items() if b[0] == b[1])
        open_ = {k: b for k, b in open_.items() if b[0] != b[1]}
        small = {k: b for k, b in open_.items() if b[3] <= BRACKET}
        large = {k: b for k, b in open_.items() if b[3] > BRACKET}
        aggs = [F.sort_array(F.collect_list(inside(k[0], b))).alias(f"s{m}") for m, (k, b) in enumerate(small.items())]
        for m, (k, b) in enumerate(large.items()):
            share = (k[1] - b[2] + 0.5) / b[3]
            near = [min(max(share + d / ACCURACY, 0.0), 1.0) for d in (-1.0, 1.0)]
            aggs.append(F.percentile_approx(inside(k[0], b), near, ACCURACY).alias(f"l{m}"))
        if not aggs:
            break
        row = x.agg(*aggs).first()
        for m, (k, b) in enumerate(small.items()):
            done[k] = row[f"s{m}"][k[1] - b[2]]
        cuts = {k: (row[f"l{m}"][0], row[f"l{m}"][1]) for m, k in enumerate(large)}
        if not cuts:
            break
        c = lambda cond: F.count(F.when(cond, 1))
        row = x.agg(*[a.alias(f"{n}{m}") for m, (k, (lo, hi)) in enumerate(cuts.items()) for n, a in (
            ("below", c(F.col(f"v{k[0]}") < lo)), ("upto", c(F.col(f"v{k[0]}") <= hi)), ("at", c(F.col(f"v{k[0]}") <= lo)),
            ("to", c(F.col(f"v{k[0]}") < hi)))]
            + [f(F.when(cond, F.col(f"v{k[0]}"))).alias(f"{n}{m}") for m, (k, (lo, hi)) in enumerate(cuts.items()) for n, f, cond in (
                ("under", F.max, F.col(f"v{k[0]}") < lo), ("over", F.min, F.col(f"v{k[0]}") > hi),
                ("next", F.min, F.col(f"v{k[0]}") > lo), ("last", F.max, F.col(f"v{k[0]}") < hi))]).first()
        open_ = {}
        for m, (k, (lo, hi)) in enumerate(cuts.items()):
            b, r = large[k], k[1]
            below, at, to, upto = row[f"below{m}"], row[f"at{m}"], row[f"to{m}"], row[f"upto{m}"]
            if r < below:  # the sketch was beside the rank: what is left lies before or behind
                open_[k] = [b[0], row[f"under{m}"], b[2], below - b[2]]
            elif r < at:
                open_[k] = [lo, lo, below, at - below]
            elif r >= upto:
                open_[k] = [row[f"over{m}"], b[1], upto, b[2] + b[3] - upto]
            elif r >= to:
                open_[k] = [hi, hi, to, upto - to]
            else:  # strictly between the two cuts
                open_[k] = [row[f"next{m}"], row[f"last{m}"], at, to - at]
    out = {}
    for i, c in enumerate(cols):
        got = []
        for p in probs[c]:
            if not stats[c]["n"]:
                got.append(math.nan)
                continue
            h = p * (stats[c]["n"] - 1)
            f, g = done[i, math.floor(h)], done[i, math.ceil(h)]
            got.append(f if f == g else f + (h - math.floor(h)) * (g - f))
        out[c] = got, stats[c]
    return out


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> tuple[list[float], dict]:
    """Exact quantiles of one column, see ``exact_quantiles_of``."""
    return exact_quantiles_of(df, {col: probs})[col]


# ------------------------------------------------------------------ J4
#: Bins of a histogram; a column that would need more is told by its frequencies.
MAX_BINS = 100_000


def bin_count(quartiles: tuple[list[float], dict], bins: str | int = "fd") -> int | None:
    """Bins of a column with these (75 %, 25 %) quartiles and stats; None where
    there is no histogram: an infinite range, or more than ``MAX_BINS``."""
    (q75, q25), st = quartiles
    first, last = float(st["min"]), float(st["max"])
    if not math.isfinite(last - first):
        return None
    if isinstance(bins, int):
        return bins if bins <= MAX_BINS else None
    if first == last:
        first, last = first - 0.5, last + 0.5
    width = 2.0 * (q75 - q25) * st["n"] ** (-1.0 / 3.0)
    need = (last - first) / width if width > 0 else 1.0
    return int(math.ceil(need)) if need <= MAX_BINS else None


def hist_or_freq(df: DataFrame, col: str, bins: str | int = "fd", topn: int = 5,
                 quartiles: tuple[list[float], dict] | None = None) -> DataFrame:
    """``(kind, key, value)``: the histogram of a column (kind ``hist``, key the
    bin's left edge, value its density), or its frequencies (kind ``freq``)
    where it has no histogram."""
    quartiles = quartiles or exact_quantiles(df, col, [0.75, 0.25])
    if quartiles[1]["n"] and bin_count(quartiles, bins) is None:
        return freq(df, col, topn).select(F.lit("freq").alias("kind"), "key", F.col("share").alias("value"))
    return hist(df, col, bins, quartiles).select(F.lit("hist").alias("kind"), F.format_string("%.6f", F.col("left")).alias("key"),
                                                 F.col("density").alias("value"))


def hist(df: DataFrame, col: str, bins: str | int = "fd", quartiles: tuple[list[float], dict] | None = None) -> DataFrame:
    """Density histogram with numpy's bin edges; ``bins='fd'`` uses the
    Freedman–Diaconis width ``2·IQR·n^(-1/3)`` (IQR 0 -> one bin).

    Returns ``(bin bigint, left double, density double)`` for every bin;
    ``hist_or_freq`` for columns that may have none.
    """
    spark = df.sparkSession
    quartiles = quartiles or exact_quantiles(df, col, [0.75, 0.25])
    st = quartiles[1]
    n, lo, hi = st["n"], st["min"], st["max"]
    if n == 0:
        return spark.createDataFrame([], "bin bigint, left double, density double")
    first, last = float(lo), float(hi)
    if first == last:
        first, last = first - 0.5, last + 0.5
    nb = bin_count(quartiles, bins)
    if nb is None:
        raise ValueError(f"{col} has no histogram of at most {MAX_BINS} bins")
    step = (last - first) / nb
    edges = spark.range(nb + 1).select(
        F.col("id").alias("i"),
        F.when(F.col("id") == nb, F.lit(last)).otherwise(F.col("id") * F.lit(step) + F.lit(first)).alias("e"))
    norm = nb / (last - first)
    idx = F.floor((F.col("v") - F.lit(first)) * F.lit(norm)).cast("bigint")
    idx = F.when(idx >= nb, nb - 1).otherwise(idx)
    x = df.select(F.col(col).cast("double").alias("v")) \
        .filter(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("i", idx)
    # numpy's edge corrections: compare with the computed edges
    e_lo = F.col("i") * F.lit(step) + F.lit(first)
    e_hi = F.when(F.col("i") + 1 == nb, F.lit(last)).otherwise((F.col("i") + 1) * F.lit(step) + F.lit(first))
    x = x.withColumn("i", F.when(F.col("v") < e_lo, F.col("i") - 1)
                     .when((F.col("v") >= e_hi) & (F.col("i") != nb - 1), F.col("i") + 1)
                     .otherwise(F.col("i")))
    counts = x.groupBy("i").agg(F.count(F.lit(1)).alias("c"))
    e2 = edges.select(F.col("i").alias("i2"), F.col("e").alias("e2"))
    out = edges.filter(F.col("i") < nb).join(counts, "i", "left") \
        .join(e2, F.col("i2") == F.col("i") + 1)
    dens = F.coalesce(F.col("c"), F.lit(0)) / (F.lit(float(n)) * (F.col("e2") - F.col("e")))
    return out.select(F.col("i").alias("bin"), F.col("e").alias("left"), dens.alias("density"))


# ------------------------------------------------------------------ J5
def ts_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).cast("string").alias("min"), F.max(col).cast("string").alias("max"))


# ------------------------------------------------------------------ J6 / J7
def _column_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row for all ``cols``, from two scans whatever their number: ``more{i}``
    (a third distinct value: one that is neither the least nor the greatest),
    ``frac{i}`` (a fractional part or NaN), ``inf{i}``, ``some{i}`` (a value
    other than null and NaN)."""
    x = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    ends = x.agg(*[f(f"c{i}").alias(f"{n}{i}") for i in range(len(cols)) for n, f in (("lo", F.min), ("hi", F.max))])
    out = []
    for i, c in enumerate(cols):
        v, flag = F.col(f"c{i}"), {}
        flag["more"] = (v != F.col(f"lo{i}")) & (v != F.col(f"hi{i}"))
        flag["some"] = v.isNotNull()
        if isinstance(df.schema[c].dataType, T.FractionalType):
            d = v.cast("double")
            flag["some"] = v.isNotNull() & ~F.isnan(d)
            flag["frac"] = F.isnan(d) | (d != F.floor(d))
            flag["inf"] = F.abs(d) == F.lit(math.inf)
        out += [F.coalesce(F.bool_or(flag.get(n, F.lit(False))), F.lit(False)).alias(f"{n}{i}")
                for n in ("more", "some", "frac", "inf")]
    return x.crossJoin(F.broadcast(ends)).agg(*out)        # ends is one row


def _target_type(i: int):
    return F.when(F.col(f"frac{i}"), "continuous").when(F.col(f"more{i}"), "multiclass").otherwise("binary")


def target_type_col(df: DataFrame, col: str) -> DataFrame:
    """``binary`` (<=2 distinct), ``multiclass``, or ``continuous`` (a float
    column holding a value with a fractional part) — one-row result."""
    return _column_flags(df, [col]).select(_target_type(0).alias("target_type"))


def task_type(target_type: str, explicit: str | None = None, backend: str = "default") -> str:
    """Continuous -> regression, discrete -> classification (an explicit
    task wins for discrete targets; regression on a continuous target only).
    The alternate backend maps multiclass to regression."""
    if target_type == "continuous":
        if explicit and explicit != "regression":
            return "invalid"
        return "regression"
    if backend != "default" and target_type == "multiclass":
        return "regression"
    if explicit in ("regression", "classification"):
        return explicit
    return "classification"


def task_type_col(target_type):
    c = F.col(target_type) if isinstance(target_type, str) else target_type
    return F.when(c == "continuous", "regression").otherwise("classification")


# ------------------------------------------------------------------ J1
def profile(df: DataFrame, formats: dict | None = None, topn: int = 5, languages: DataFrame | None = None,
            id_col: str | None = None) -> DataFrame:
    """Table summary as rows ``(column, kind, key, value, target_type)``.

    ``kind`` is ``freq`` (text/bool: key = value, value = share), ``range``
    (datetime: key min/max, value epoch seconds) or ``hist`` (numbers:
    key = bin left edge as text, value = density). A number column that holds
    an infinity or would need more than ``MAX_BINS`` bins is profiled by
    ``freq``; one without any value has a single row with null key and value.
    With language profiles in ``languages`` (and the table's ``id_col``), text
    columns that are not binary also have rows of kind ``languages`` (key = the
    language, value = its rows), all columns from one detection. Types of all
    columns come from one job and their quartiles from another few; the union
    is lazy.
    """
    scheme = resolve_types(df.schema, formats)
    parts = []
    flags = _column_flags(df, df.columns)
    flags = flags.select("*", *[_target_type(i).alias(f"tt{i}") for i in range(len(df.columns))]).first()
    binned = [c for i, (c, t) in enumerate(scheme.items()) if t in ("int", "float") and flags[f"some{i}"] and not flags[f"inf{i}"]]
    quartiles = exact_quantiles_of(df, {c: [0.75, 0.25] for c in binned}) if binned else {}
    for i, (c, t) in enumerate(scheme.items()):
        tt = flags[f"tt{i}"]
        if t in ("int", "float") and not flags[f"some{i}"]:
            part = df.sparkSession.range(1).select(F.lit(c).alias("column"), F.lit("hist").alias("kind"),
                                                   F.lit(None).cast("string").alias("key"),
                                                   F.lit(None).cast("double").alias("value"))
        elif t in ("str", "bool") or flags[f"inf{i}"]:
            f = freq(df, c, topn)
            part = f.select(F.lit(c).alias("column"), F.lit("freq").alias("kind"), "key",
                            F.col("share").alias("value"))
        elif t == "datetime":
            r = df.agg(F.min(c).alias("a"), F.max(c).alias("b"))
            part = r.select(F.lit(c).alias("column"), F.lit("range").alias("kind"),
                            F.explode(F.array(
                                F.struct(F.lit("min").alias("key"),
                                         (F.unix_micros(F.col("a").cast("timestamp")) / 1e6).alias("value")),
                                F.struct(F.lit("max").alias("key"),
                                         (F.unix_micros(F.col("b").cast("timestamp")) / 1e6).alias("value")))).alias("kv")
                            ).select("column", "kind", "kv.key", "kv.value")
        else:
            part = hist_or_freq(df, c, topn=topn, quartiles=quartiles[c]).select(F.lit(c).alias("column"), "kind", "key", "value")
        parts.append(part.withColumn("target_type", F.lit(tt)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    text = [c for i, (c, t) in enumerate(scheme.items()) if t == "str" and flags[f"more{i}"]]
    if languages is not None and text:
        from cadence.operators.language import language_stats

        named = F.create_map(*[F.lit(x) for i, c in enumerate(scheme) for x in (c, flags[f"tt{i}"])])
        out = out.unionByName(language_stats(df, id_col, text, languages).select(
            "column", F.lit("languages").alias("kind"), F.col("lang").alias("key"), F.col("n").cast("double").alias("value"),
            named[F.col("column")].alias("target_type")))
    return out


def text_columns(df: DataFrame, formats: dict | None = None) -> list[str]:
    """Text columns worth language detection: ``str`` and not binary."""
    scheme = resolve_types(df.schema, formats)
    cand = [c for c, t in scheme.items() if t == "str"]
    if not cand:
        return []
    row = _column_flags(df, cand).first()
    return [c for i, c in enumerate(cand) if row[f"more{i}"]]
