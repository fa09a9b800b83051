"""Skew-safe per-key window plans.

A per-key window (``partitionBy(user)``) puts every row of a key into one
task. When one user or merchant holds a third of all rows, that task holds a
third of the data. The helpers below cut every key into chunks of event time,
so that a hot key is spread over many tasks, and still give exact results:

* ``with_chunks`` - the chunk of each row, ``CHUNK_US`` of event time. Every
  key takes the same plan; a task holds what one key has in that time.
* ``prefix_aggregate`` - unbounded running aggregates (cumulative sums,
  running max). Local running values per ``(key, chunk)`` plus the combined
  totals of all earlier chunks of the key. The chunk-total table has one row
  per (key, chunk), so its per-key window is small even for a hot key.
* ``window_aggregates`` - trailing-window counts and sums as differences of
  two running totals, however long the window.
* ``prior_moments`` - running count / mean / M2 (population variance) of the
  rows before the current one, merged across chunks with Chan's formula.
* ``global_lag`` - the previous row of the key at any distance in time.

Keys may be null (all such rows are one key, as in a plain window) and ids may
repeat: nothing is joined by id. The joins back to the rows are equi-joins on
``(key, chunk)``; AQE picks broadcast only when the runtime size of the chunk
table is below the broadcast threshold, sort-merge otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY_US

CHUNK = "_chunk"
KEY = "_key"
HOME = "_home"
HALO = "_halo"

CHUNK_US = 3600 * 1_000_000    # event time of a key that one task holds


def chunk_of(us: Column, chunk_us: int) -> Column:
    """Chunk number of an epoch-microsecond value (floor division, exact)."""
    c = F.lit(int(chunk_us))
    return ((us - F.pmod(us, c)) / c).cast("long")


def key_of(key: str) -> Column:
    """The key as a string that is never null."""
    return F.coalesce(F.col(key).cast("string"), F.lit("\u0000"))


def with_chunks(df: DataFrame, key: str, us: str, chunk_us: int | None = None) -> DataFrame:
    """Add ``_key`` (the key, never null) and ``_chunk``."""
    cols = [c for c in df.columns if c not in (CHUNK, KEY)]
    return df.select(*cols, key_of(key).alias(KEY), chunk_of(F.col(us), chunk_us or CHUNK_US).alias(CHUNK))


def _join_back(d: DataFrame, offs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Left-join per-chunk offsets to the rows.

    Equi-keys are the first key and the chunk - exactly the (key, chunk)
    hash partitioning the rows already have from their windows - so only
    the small offsets side is shuffled (or broadcast by AQE). Further keys
    (e.g. a session id) are a residual condition written so that the
    planner does not turn them into equi-keys. Keys are never null
    (``with_chunks``); the small side's columns are renamed to avoid
    self-join ambiguity.
    """
    ren = {c: f"_j{i}" for i, c in enumerate(cols)}
    o = offs.select(*[F.col(c).alias(ren.get(c, c)) for c in offs.columns])
    equi = ([cols[0]] if cols[0] != CHUNK else []) + [CHUNK] if CHUNK in cols else list(cols)
    cond = None
    for c in cols:
        if c in equi:
            e = F.col(c) == F.col(ren[c])
        else:
            e = (F.col(c) - F.col(ren[c])) == F.lit(0)  # residual, numeric keys
        cond = e if cond is None else cond & e
    return d.join(o, cond, "left").drop(*ren.values())


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def prefix_aggregate(df: DataFrame, keys: Sequence[str], us: str,
                     specs: Sequence[tuple[str, Column, str]],
                     tiebreak: Sequence[str] = (), frame: str = "rows",
                     include_current: bool = False,
                     chunk_us: int = DAY_US) -> DataFrame:
    """Running aggregates per key without a per-key task.

    ``specs``: ``(name, value Column, kind)`` with kind ``sum``/``max``/``min``.
    ``frame="rows"``: rows before the current one in ``(us, *tiebreak)``
    order (plus itself when ``include_current``). ``frame="range"``: rows
    with a strictly smaller ``us`` (``<=`` when ``include_current``).
    Sums of an empty set are 0; max/min of an empty set are null.
    """
    keys = list(keys)
    base = [F.col(c) for c in df.columns if c != CHUNK]
    chunk = F.col(CHUNK) if CHUNK in df.columns else chunk_of(F.col(us), chunk_us)
    d = df.select(*base, chunk.alias(CHUNK), *[expr.alias("_v_" + name) for name, expr, _ in specs])
    upper = 0 if include_current else -1
    if frame == "rows":
        w = (Window.partitionBy(*keys, CHUNK).orderBy(us, *tiebreak)
             .rowsBetween(Window.unboundedPreceding, upper))
    else:
        w = (Window.partitionBy(*keys, CHUNK).orderBy(us)
             .rangeBetween(Window.unboundedPreceding, upper))
    d = d.select("*", *[_COMBINE[kind](F.col("_v_" + name)).over(w).alias("_l_" + name)
                        for name, _, kind in specs])

    totals = d.groupBy(*keys, CHUNK).agg(
        *[_COMBINE[kind](F.col("_v_" + name)).alias("_t_" + name) for name, _, kind in specs])
    wc = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*keys, CHUNK, *[
        _COMBINE[kind](F.col("_t_" + name)).over(wc).alias("_o_" + name)
        for name, _, kind in specs])

    j = _join_back(d, offs, keys + [CHUNK])
    out_cols = [F.col(c) for c in df.columns]
    for name, _, kind in specs:
        loc, off = F.col("_l_" + name), F.col("_o_" + name)
        if kind == "sum":
            val = F.coalesce(loc, F.lit(0)) + F.coalesce(off, F.lit(0))
        elif kind == "max":
            val = F.greatest(loc, off)
        else:
            val = F.least(loc, off)
        out_cols.append(val.alias(name))
    return j.select(*out_cols)


def merged_moments() -> tuple[Column, Column, Column]:
    """Count, mean and M2 of a chunk's rows so far (``_ln``, ``_lmean``, ``_lm2``)
    and its key's earlier chunks (``_on`` and sums centred on ``_ref``: ``_os``, ``_oq``, ``_om2``)."""
    n_p = F.coalesce(F.col("_on"), F.lit(0)).cast("double")
    s_p = F.coalesce(F.col("_os"), F.lit(0.0))
    mean_p = F.col("_ref") + F.try_divide(s_p, n_p)
    m2_p = F.greatest(F.lit(0.0),
                      F.coalesce(F.col("_om2"), F.lit(0.0)) + F.coalesce(F.col("_oq"), F.lit(0.0))
                      - F.try_divide(s_p * s_p, n_p))
    n_l = F.col("_ln").cast("double")
    n = n_p + n_l
    delta = F.col("_lmean") - mean_p
    mean = (F.when(n_p == 0, F.col("_lmean"))
             .when(n_l == 0, mean_p)
             .otherwise(mean_p + F.try_divide(delta * n_l, n)))
    m2 = (F.when(n_p == 0, F.col("_lm2"))
           .when(n_l == 0, m2_p)
           .otherwise(m2_p + F.col("_lm2") + F.try_divide(delta * delta * n_p * n_l, n)))
    return n, mean, m2


def prior_moments(df: DataFrame, keys: Sequence[str], us: str, x: str,
                  tiebreak: Sequence[str] = (), prefix: str = "p",
                  chunk_us: int = DAY_US) -> DataFrame:
    """Count, mean and M2 of ``x`` over the key's rows before the current one.

    Adds ``{prefix}_n`` (long), ``{prefix}_mean`` (null when n = 0) and
    ``{prefix}_m2`` (sum of squared deviations; population variance =
    m2 / n). Within a chunk Spark's running ``avg``/``var_pop`` are used;
    earlier chunks are summed after centring on the key's first chunk mean
    and merged with Chan's parallel formula.
    """
    keys = list(keys)
    chunk = F.col(CHUNK) if CHUNK in df.columns else chunk_of(F.col(us), chunk_us)
    d = df.select(*[F.col(c) for c in df.columns if c != CHUNK], chunk.alias(CHUNK))
    w = (Window.partitionBy(*keys, CHUNK).orderBy(us, *tiebreak)
         .rowsBetween(Window.unboundedPreceding, -1))
    cnt = F.count(F.col(x)).over(w)
    d = d.select("*", cnt.alias("_ln"), F.avg(F.col(x)).over(w).alias("_lmean"),
                 (F.coalesce(F.var_pop(F.col(x)).over(w), F.lit(0.0)) * cnt).alias("_lm2"))

    tot = d.groupBy(*keys, CHUNK).agg(
        F.count(F.col(x)).alias("_tn"), F.avg(F.col(x)).alias("_tmean"),
        (F.coalesce(F.var_pop(F.col(x)), F.lit(0.0)) * F.count(F.col(x))).alias("_tm2"))
    wk = Window.partitionBy(*keys).orderBy(CHUNK)
    prev = wk.rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_ref", F.first("_tmean", ignorenulls=True).over(
        wk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    dev = F.col("_tmean") - F.col("_ref")
    offs = tot.select(
        *keys, CHUNK, "_ref",
        F.sum("_tn").over(prev).alias("_on"),
        F.sum(F.col("_tn") * dev).over(prev).alias("_os"),
        F.sum(F.col("_tn") * dev * dev).over(prev).alias("_oq"),
        F.sum("_tm2").over(prev).alias("_om2"))
    j = _join_back(d, offs, keys + [CHUNK])

    n, mean, m2 = merged_moments()
    return j.select(*[F.col(c) for c in df.columns],
                    n.cast("long").alias(f"{prefix}_n"),
                    F.when(n > 0, mean).alias(f"{prefix}_mean"),
                    F.when(n > 0, m2).otherwise(F.lit(0.0)).alias(f"{prefix}_m2"))


def global_lag(df: DataFrame, keys: Sequence[str], us: str, cols: Sequence[str],
               tiebreak: Sequence[str] = (), prefix: str = "prev_",
               chunk_us: int = DAY_US) -> DataFrame:
    """Previous row's ``cols`` (and ``us``) per key, however far back.

    Within a chunk a plain ``lag``; the first row of a chunk takes the last
    row of the nearest earlier non-empty chunk of the key.
    """
    keys = list(keys)
    carry = [us] + [c for c in cols if c != us]
    d = df if CHUNK in df.columns else df.withColumn(CHUNK, chunk_of(F.col(us), chunk_us))
    w = Window.partitionBy(*keys, CHUNK).orderBy(us, *tiebreak)
    d = d.withColumn("_lprev", F.lag(F.struct(*[F.col(c) for c in carry]), 1).over(w))
    order_key = F.struct(*[F.col(c) for c in [us, *tiebreak]])
    last = d.groupBy(*keys, CHUNK).agg(
        F.max_by(F.struct(*[F.col(c) for c in carry]), order_key).alias("_last"))
    wc = Window.partitionBy(*keys).orderBy(CHUNK)
    offs = last.select(*keys, CHUNK, F.lag("_last", 1).over(wc).alias("_cprev"))
    j = _join_back(d, offs, keys + [CHUNK])
    prev = F.coalesce(F.col("_lprev"), F.col("_cprev"))
    return j.select(*[F.col(c) for c in df.columns],
                    *[prev[c].alias(prefix + c) for c in carry])


def with_ranges(df: DataFrame, order: str, sums: Sequence[str], ranges: int = 64) -> DataFrame:
    """Adds ``_chunk``, one of ``ranges`` ** 2 ranges of about equally many
    rows in the order of ``order``, cut by a quantile sketch, and ``total_<s>``
    over all rows. Cut points are looked up in two steps of ``ranges``."""
    n = ranges
    x = F.col(order).cast("double")
    at = F.array(*[F.lit(i / (n * n)) for i in range(1, n * n)])
    one = df.agg(F.percentile_approx(F.when(~F.isnan(x), x), at, 4 * n * n).alias("_cuts"),
                 *[F.sum(s).alias("total_" + s) for s in sums])
    one = one.withColumn("_blocks", F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                                lambda j: F.slice("_cuts", j * n + 1, n)))
    one = one.select(F.struct("_blocks", F.transform("_blocks", lambda c: F.get(c, F.lit(0))).alias("_heads"),
                              *["total_" + s for s in sums]))

    def up_to(cuts: Column) -> Column:
        return F.coalesce(F.size(F.filter(cuts, lambda c: c <= x)), F.lit(0))

    d = df.withColumn("_one", one.scalar()).select("*", "_one.*").withColumn("_h", up_to(F.col("_heads")))
    b = F.when(F.col("_h") > 0, (F.col("_h") - 1) * n + up_to(F.get("_blocks", F.col("_h") - 1))).otherwise(0)
    return d.withColumn(CHUNK, b.cast("long")).drop("_one", "_blocks", "_heads", "_h")


def ordered_prefix(df: DataFrame, order: str, sums: Sequence[str], descending: bool = True,
                   ranges: int = 64) -> DataFrame:
    """Exact running sums over a global order without a one-task window.

    Rows (already one per distinct ``order`` value) fall into ``ranges`` ** 2
    ranges of about equally many rows, cut by a quantile sketch of ``order``,
    so that values crowded anywhere spread alike. Running sums are local to a
    range, which adds the totals of all ranges before it; the only global
    window runs over the ranges' totals. ``df`` is read twice: for the sketch
    and the overall totals, and for the rows. Adds ``cum_<s>``
    (inclusive) and ``total_<s>`` for each ``s``. Nulls are in the lowest
    range, NaN in the highest; an empty table gives an empty table.
    """
    d = with_ranges(df, order, sums, ranges)
    o = F.desc(order) if descending else F.asc(order)
    oc = F.desc(CHUNK) if descending else F.asc(CHUNK)
    w = Window.partitionBy(CHUNK).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(s).over(w).alias("_l_" + s) for s in sums])
    tot = d.groupBy(CHUNK).agg(*[F.sum(s).alias("_t_" + s) for s in sums])
    wc = Window.orderBy(oc).rowsBetween(Window.unboundedPreceding, -1)  # over ranges only
    offs = tot.select(CHUNK, *[F.sum("_t_" + s).over(wc).alias("_o_" + s) for s in sums])
    j = _join_back(d, offs, [CHUNK])
    return j.select(*[F.col(c) for c in df.columns],
                    *[(F.col("_l_" + s) + F.coalesce(F.col("_o_" + s), F.lit(0))).alias("cum_" + s)
                      for s in sums], *["total_" + s for s in sums])


def window_aggregates(df: DataFrame, key: str, us: str, counts: dict[str, tuple[int | None, int]],
                      sums: dict[str, tuple[Column, int | None, int]] | None = None, asks: Column | None = None) -> DataFrame:
    """Counts and sums of a key's rows in trailing windows, exactly and
    without halo copies: (_wk, _wt, names...), a row for each (key, time),
    or only for those with a row for which ``asks`` is true.

    ``counts``: name -> (lo, hi), the rows with ``t - lo <= us < t + hi``
    (``lo`` None: all rows before); ``sums``: name -> (value, lo, hi). They
    depend on the key and the time alone, so rows are first reduced to one per
    (key, time); a window is the difference of two running totals, read at
    probe rows placed at its ends in the same chunked pass. A probe has weight 0,
    but that at the row's own time is the row itself. Sums
    use DECIMAL running totals, whose differences cancel nothing. Every task
    holds one (key, chunk).
    """
    sums = dict(sums or {})
    spans = [*counts.values(), *[(lo, hi) for _, lo, hi in sums.values()]]
    ends = sorted({-lo for lo, _ in spans if lo is not None} | {hi for _, hi in spans})
    dec = "decimal(38,10)"
    base = df.groupBy(key_of(key).alias(KEY), F.col(us).alias("_wt")).agg(
        F.count(F.lit(1)).alias("_one"), *([] if asks is None else [F.max(F.coalesce(asks, F.lit(False))).alias("_asks")]),
        *[F.coalesce(F.sum(x.cast(dec)), F.lit(0)).cast(dec).alias("_x_" + name) for name, (x, _, _) in sums.items()])
    itself = F.lit(None).cast("long")
    probes = F.array(*[F.lit(e).cast("long") for e in ends], *([] if 0 in ends else [itself]))
    e = F.explode(probes if asks is None else F.when(F.col("_asks"), probes).otherwise(F.array(itself))).alias("_e")
    weights = ["_one", *["_x_" + name for name in sums]]
    u = base.select("*", e).select(
        KEY, "_e", (F.col("_wt") + F.coalesce("_e", F.lit(0))).alias("_t"),
        *[F.when(F.coalesce("_e", F.lit(0)) == 0 if 0 in ends else F.col("_e").isNull(), F.col(c)).otherwise(F.lit(0)).alias(c) for c in weights])
    u = u.select("*", chunk_of(F.col("_t"), CHUNK_US).alias(CHUNK))
    specs = [("_N" + c, F.col(c), "sum") for c in weights]
    u = prefix_aggregate(u, [KEY], "_t", specs, frame="range", include_current=False)

    def total(c: str, lo: int | None, hi: int) -> Column:
        def at(end: int) -> Column:
            return F.max(F.when(F.col("_e") == end, F.col("_N" + c)))
        return at(hi) if lo is None else at(hi) - at(-lo)

    return u.where(F.col("_e").isNotNull()).groupBy(F.col(KEY).alias("_wk"), (F.col("_t") - F.col("_e")).alias("_wt")).agg(
        *[total("_one", lo, hi).alias(name) for name, (lo, hi) in counts.items()],
        *[total("_x_" + name, lo, hi).cast("double").alias(name) for name, (_, lo, hi) in sums.items()])


def join_windows(df: DataFrame, key: str, us: str | Column, windows: DataFrame) -> DataFrame:
    """The windows at each row's key and time; null where there is no time."""
    t = F.col(us) if isinstance(us, str) else us
    return df.join(windows, (key_of(key) == F.col("_wk")) & (t == F.col("_wt")), "left").drop("_wk", "_wt")
