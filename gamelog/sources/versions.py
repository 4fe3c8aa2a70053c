"""Season tables that are replaced all at once.

A table is a folder of writes, ``<root>/write=<name>/Season=<year>``, and a manifest that
says which write of every season counts. New files are staged where no reader looks; the
manifest of the next version, one file, is written last. A write that dies on the way leaves
readers with the seasons as they were. Two writers of one version cannot both commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gamelog.operators.skew import MOST_HOT, heavy_hitters, key_hash

SEASON = "Season"
MANIFEST = "_manifest"
_SCHEMA = f"{SEASON} int, path string, n_rows long, heavy map<string, map<string, long>>, version long"

# Key columns by the name under which their frequent values are kept.
KeySets = Mapping[str, Sequence[str]]


@dataclass(frozen=True)
class SeasonFiles:
    """Where a season's rows are, how many, and the counts of its frequent keys."""

    path: str
    n_rows: int
    heavy: dict[str, dict[int, int]] = field(default_factory=dict)


def current(spark: SparkSession, root: str) -> tuple[int, dict[int, SeasonFiles]]:
    """The latest version and its seasons; 0 and none if nothing was committed."""
    try:
        rows = spark.read.schema(_SCHEMA).json(f"{root}/{MANIFEST}")
        latest = rows.agg(F.max("version")).first()[0]
        found = rows.where(F.col("version") == F.lit(latest)).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    heavy = lambda sets: {name: {int(k): n for k, n in keys.items()} for name, keys in (sets or {}).items()}
    return latest or 0, {r[SEASON]: SeasonFiles(r["path"], r["n_rows"], heavy(r["heavy"])) for r in found}


def commit(spark: SparkSession, root: str, version: int, changed: Mapping[int, SeasonFiles]) -> None:
    """Make the changed seasons count; all others stay as they are."""
    _, seasons = current(spark, root)
    seasons = {**seasons, **changed}
    heavy = lambda f: {name: {str(k): n for k, n in keys.items()} for name, keys in f.heavy.items()}
    rows = [(s, f.path, f.n_rows, heavy(f)) for s, f in sorted(seasons.items())]
    frame = spark.createDataFrame(rows, _SCHEMA.rsplit(",", 1)[0])
    # Fails if another writer has committed this version.
    frame.coalesce(1).write.mode("error").json(f"{root}/{MANIFEST}/version={version}")


def _staged(root: str) -> str:
    """A folder of its own for every write, so that what a dead one left is in nobody's way."""
    return f"{root}/write={uuid.uuid4().hex[:12]}"


def land(df: DataFrame, root: str, season: int, key_sets: KeySets) -> SeasonFiles | None:
    """Replace one season; None, and no files, if there are no rows."""
    if df.isEmpty():
        return None
    return land_all(df.withColumn(SEASON, F.lit(int(season))), root, [season], key_sets).get(int(season))


def land_all(df: DataFrame, root: str, seasons: Sequence[int], key_sets: KeySets) -> dict[int, SeasonFiles]:
    """Replace those of the seasons that ``df`` has rows of, in one write and one version.

    ``df`` is computed once: its rows are counted, and the frequent values of every key set,
    by season while they are written.
    """
    spark, seasons = df.sparkSession, [int(s) for s in seasons]
    version = current(spark, root)[0] + 1
    rows = df.withColumn(SEASON, F.col(SEASON).cast("int")).where(F.col(SEASON).isin(*seasons))
    measures = []
    for s in seasons:
        of = F.col(SEASON) == s
        measures.append(F.count_if(of).alias(f"n_{s}"))
        # rows of other seasons are NULL, which may take one of the places
        measures += [heavy_hitters(F.when(of, F.col(f"_key_{n}")), MOST_HOT + 1).alias(f"{n}_{s}") for n in key_sets]
    names = {f"_key_{name}": key_hash(columns) for name, columns in key_sets.items()}
    staged, seen = _staged(root), Observation()
    rows.withColumns(names).observe(seen, *measures).select(*rows.columns).write.partitionBy(SEASON).parquet(staged)
    found = seen.get
    heavy = lambda s, name: {i["item"]: i["count"] for i in found[f"{name}_{s}"] if i["item"] is not None}
    changed = {
        s: SeasonFiles(f"{staged}/{SEASON}={s}", found[f"n_{s}"], {n: dict(list(heavy(s, n).items())[:MOST_HOT]) for n in key_sets})
        for s in seasons
        if found[f"n_{s}"]
    }
    if changed:
        commit(spark, root, version, changed)
    return changed


def replace(df: DataFrame, root: str) -> dict[int, SeasonFiles]:
    """Replace the seasons that ``df`` holds, in one write."""
    spark = df.sparkSession
    version = current(spark, root)[0] + 1
    staged = _staged(root)
    df.write.partitionBy(SEASON).parquet(staged)
    counts = spark.read.parquet(staged).groupBy(SEASON).count().collect()  # from the footers
    changed = {r[SEASON]: SeasonFiles(f"{staged}/{SEASON}={r[SEASON]}", r["count"]) for r in counts}
    commit(spark, root, version, changed)
    return changed


def read(spark: SparkSession, root: str, seasons: Sequence[int] | None = None) -> DataFrame | None:
    """The current rows of all or some seasons (only their folders are read); None without a
    manifest, an error for a season that it does not have."""
    _, have = current(spark, root)
    if not have:
        return None
    wanted = sorted(have) if seasons is None else [int(s) for s in seasons]
    missing = [s for s in wanted if s not in have]
    if missing:
        raise FileNotFoundError(f"no data at {root} for seasons {missing}")
    return spark.read.option("basePath", root).parquet(*[have[s].path for s in wanted]).drop("write")


def heavy_keys(spark: SparkSession, root: str, seasons: Sequence[int] | None = None) -> tuple[int, dict[str, dict[int, int]]]:
    """Rows of the seasons, and by key set the counts of their frequent keys: no scan."""
    _, have = current(spark, root)
    chosen = [have[s] for s in (have if seasons is None else [int(s) for s in seasons]) if s in have]
    counts: dict[str, dict[int, int]] = {}
    for files in chosen:
        for name, keys in files.heavy.items():
            total = counts.setdefault(name, {})
            for key, n in keys.items():
                total[key] = total.get(key, 0) + n
    return sum(f.n_rows for f in chosen), counts
