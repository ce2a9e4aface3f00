"""Derived features, selection, scaling and encoding."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import features as X
from tidewright.operators.cleaning import clean_records
from tidewright.operators.ordered import over_last_rows, with_ordinal
from tidewright.operators.quantiles import exact_quantiles
from tidewright.schema import ROW_ID, numeric_columns, quoted, text_columns
from tidewright.sources.readers import with_chunks
from tidewright.storage import read_json, stored, write_json

TARGET = "salary"
RAW_ONLY = ("version", "b_day", "draft_year", "weight", "height")


def calendar_features(df: DataFrame, strict: bool = False) -> DataFrame:
    """version_year, age, experience, bmi, birth_month, draft_decade."""
    return df.withColumn("version_year", X.trailing_year(F.col("version"), strict)).withColumns(
        {
            "age": X.years_since(F.col("version_year"), F.col("b_day")),
            "experience": X.years_since(F.col("version_year"), F.col("draft_year")),
            "bmi": X.body_mass(F.col("weight"), F.col("height")),
            "birth_month": F.month("b_day"),
            "draft_decade": X.decade(F.col("draft_year")),
        }
    )


def rolling(df: DataFrame, value: str, order: list[str] | None, window: int = 5, mode: str = "batch", prefix: str | None = None) -> DataFrame:
    """Mean and deviation over the last ``window`` rows of the whole order (one row at least).

    ``mode`` batch has the sample deviation, stream the population's; one value has deviation 0.
    """
    name = prefix or f"{value}_roll"
    spread = F.stddev_samp if mode == "batch" else F.stddev_pop
    placed = df if ROW_ID in df.columns and order is None else with_ordinal(df.drop(ROW_ID), order)
    return over_last_rows(placed, window, {f"{name}_mean": lambda w: F.avg(value).over(w), f"{name}_std": lambda w: F.coalesce(spread(value).over(w), F.lit(0.0))})


def zscore_anomaly(df: DataFrame, value: str, limit: float = 2.5, by: str | None = None, name: str | None = None) -> DataFrame:
    """1 where a value is more than ``limit`` population deviations from the mean, else 0.

    Over the whole table, from one aggregated row (deviation 0 flags nothing);
    with ``by`` (a chunk) over its group, deviation 0 counting as 1.
    """
    name, v = name or f"{value}_anomaly", F.col(quoted(value))
    if by is None:
        got = df.agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).first()
        flag = F.lit(False) if not got["s"] else F.abs((v - F.lit(got["m"])) / F.lit(got["s"])) > limit
        return df.withColumn(name, F.coalesce(flag, F.lit(False)).cast("int"))
    stats = df.groupBy(F.col(by).alias("__by")).agg(F.avg(v).alias("__m"), F.stddev_pop(v).alias("__s"))
    z = F.abs((v - F.col("__m")) / F.coalesce(F.nullif(F.col("__s"), F.lit(0.0)), F.lit(1.0)))
    joined = df.join(stats, F.col(by).eqNullSafe(F.col("__by")), "left")
    return joined.withColumn(name, F.coalesce(z > limit, F.lit(False)).cast("int")).drop("__by", "__m", "__s")


def build_features(df: DataFrame, rolling_window: int = 5) -> DataFrame:
    """The nine derived columns of a cleaned table; _row_id is the order by year, then by the order of the input."""
    featured = calendar_features(df if ROW_ID in df.columns else with_ordinal(df)).withColumnRenamed(ROW_ID, "_input_id")
    rolled = rolling(featured, TARGET, ["version_year", "_input_id"], rolling_window)
    return zscore_anomaly(rolled.drop("_input_id"), TARGET)


def prepare(cleaned: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Features of a cleaned table, pruned and encoded; the features are stored once for all the statistics on them."""
    return encode_and_scale(drop_collinear(stored(build_features(cleaned)), threshold=threshold))


def build_features_chunked(df: DataFrame, chunk_size: int, rolling_window: int = 5) -> DataFrame:
    """The streaming form over a table: years are ordered inside chunks, the window runs on across chunks, anomalies are a chunk's own."""
    chunked = calendar_features(with_chunks(df, chunk_size)).withColumnRenamed(ROW_ID, "_input_id")
    rolled = rolling(chunked, TARGET, ["chunk_id", "version_year", "_input_id"], rolling_window, mode="stream")
    return zscore_anomaly(rolled, TARGET, by="chunk_id").drop("_input_id")


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """Distinct values of each column, null as one of them, in one aggregation."""
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return {}
    got = df.agg(*[(F.count_distinct(F.col(quoted(c))) + F.coalesce(F.max(F.col(quoted(c)).isNull().cast("int")), F.lit(0))).alias(f"n{k}") for k, c in enumerate(columns)]).first()
    return {c: got[f"n{k}"] for k, c in enumerate(columns)}


def drop_high_cardinality(df: DataFrame, limit: int = 50) -> DataFrame:
    """Without text columns of ``limit`` values or more, null counting as one.

    One pass of sketches (5 % error) settles all columns but those within a
    factor of 2 of the limit, which are counted exactly.
    """
    texts = text_columns(df)
    if not texts:
        return df
    rough = df.agg(*[F.approx_count_distinct(F.col(quoted(c)), 0.05).alias(f"n{k}") for k, c in enumerate(texts)]).first()
    rough = {c: rough[f"n{k}"] for k, c in enumerate(texts)}
    near = [c for c, n in rough.items() if limit / 2 <= n <= limit * 2]
    return df.drop(*[c for c, n in (rough | distinct_counts(df, near)).items() if n >= limit])


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with two values or more, null counting as one, from one pass of minima and maxima."""
    if not columns:
        return []
    parts = []
    for k, c in enumerate(columns):
        col = F.col(quoted(c))
        mixed = F.coalesce(F.min(col) != F.max(col), F.lit(False)) | ((F.count(col) > 0) & (F.count(col) < F.count(F.lit(1))))
        parts.append(mixed.alias(f"v{k}"))
    got = df.agg(*parts).first()
    return [c for k, c in enumerate(columns) if got[f"v{k}"]]


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Pearson correlation of every pair over its complete rows; 0 where a side is constant or empty.

    Two passes: means and null counts, then sums of products about the means.
    A column without nulls needs one sum of squares for all its pairs.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return {}
    cols = {c: F.col(quoted(c)).cast("double") for c in columns}
    got = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{k}") for k, v in enumerate(cols.values())], *[F.count(v).alias(f"n{k}") for k, v in enumerate(cols.values())]).first()
    whole = {c for k, c in enumerate(columns) if got[f"n{k}"] == got["n"]}
    centred = {c: v - F.lit(got[f"m{k}"]).cast("double") for k, (c, v) in enumerate(cols.items())}
    sums = {("s", c): F.sum(centred[c] * centred[c]) for c in columns if c in whole}
    for a, b in pairs:
        x, y = centred[a], centred[b]
        sums["xy", a, b] = F.sum(x * y)
        if not {a, b} <= whole:
            x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
            sums |= {("n", a, b): F.count(x * y), ("x", a, b): F.sum(x), ("y", a, b): F.sum(y), ("xx", a, b): F.sum(x * x), ("yy", a, b): F.sum(y * y)}
    values = dict(zip(sums, df.agg(*[e.alias(f"e{k}") for k, e in enumerate(sums.values())]).first()))
    out = {}
    for a, b in pairs:
        xy = values["xy", a, b] or 0.0
        if {a, b} <= whole:
            xx, yy = values["s", a] or 0.0, values["s", b] or 0.0
        else:
            n, x, y = values["n", a, b], values["x", a, b] or 0.0, values["y", a, b] or 0.0
            xy, xx, yy = (xy - x * y / n, values["xx", a, b] - x * x / n, values["yy", a, b] - y * y / n) if n else (0.0, 0.0, 0.0)
        out[a, b] = xy / (xx * yy) ** 0.5 if xx > 0 and yy > 0 else 0.0
    return out


def collinear_columns(df: DataFrame, target: str = TARGET, threshold: float = 0.5, skip_constant: bool = True) -> list[str]:
    """Columns to drop, in order: of the closest pair beyond ``threshold`` the one less correlated with the target.

    A pair's correlation doesn't depend on other columns, so its sums serve all rounds.
    """
    numeric = [c for c in numeric_columns(df) if c != target]
    if skip_constant:
        numeric = varying_columns(df, numeric)
    r = correlations(df, [*numeric, target])
    left, dropped = list(numeric), []
    while len(left) > 1:
        pairs = [(a, b) for i, a in enumerate(left) for b in left[i + 1 :]]
        first, second = max(pairs, key=lambda p: abs(r[p]))  # the first of equal ones
        if abs(r[first, second]) <= threshold:
            break
        loser = first if abs(r[first, target]) < abs(r[second, target]) else second
        left.remove(loser)
        dropped.append(loser)
    return dropped


def drop_collinear(df: DataFrame, target: str = TARGET, threshold: float = 0.5, skip_constant: bool = True) -> DataFrame:
    return df.drop(*collinear_columns(df, target, threshold, skip_constant))


@dataclass(frozen=True)
class Encoding:
    """Fitted statistics: medians, means and deviations of numbers, categories of text in order of appearance."""

    medians: dict[str, float | None]
    means: dict[str, float | None]
    stds: dict[str, float]
    categories: dict[str, list[str]] = field(default_factory=dict)

    def columns(self, known: set[str], named: bool = True) -> list[Column]:
        """Scaled and one-hot columns; columns missing from the input count as null."""
        out = []
        for c in self.medians:
            value = F.col(quoted(c)).cast("double") if c in known else F.lit(None).cast("double")
            filled = F.coalesce(value, F.lit(self.medians[c]).cast("double"))
            out.append(((filled - F.lit(self.means[c]).cast("double")) / F.lit(self.stds[c])).alias(c))
        for c, values in self.categories.items():
            value = F.coalesce(F.col(quoted(c)) if c in known else F.lit(None).cast("string"), F.lit(f"Unknown_{c}"))
            out += [(value == v).cast("int").alias(f"{c}__{v}" if named else v) for v in values]
        return out


    def vector(self, known: set[str]) -> Column:
        """All of ``columns`` as one sparse vector: a struct of size, indices and values, for text of many categories.

        Numbers come first, each in its place; a text has the place of its category, and none where that is unknown.
        """
        numbers = [c.cast("double") for c in Encoding(self.medians, self.means, self.stds).columns(known)]
        places, before = [], len(numbers)
        for c, values in self.categories.items():
            value = F.coalesce(F.col(quoted(c)) if c in known else F.lit(None).cast("string"), F.lit(f"Unknown_{c}"))
            at = F.array_position(F.array(*map(F.lit, values)).cast("array<string>"), value)
            places.append(F.when(at > 0, (at + (before - 1)).cast("int")))
            before += len(values)
        hot = F.filter(F.array(*places).cast("array<int>"), lambda x: x.isNotNull())
        indices = F.concat(F.array(*map(F.lit, range(len(numbers)))).cast("array<int>"), hot)
        values = F.concat(F.array(*numbers).cast("array<double>"), F.transform(hot, lambda _: F.lit(1.0)))
        return F.struct(F.lit(before).alias("size"), indices.alias("indices"), values.alias("values"))


def fit_encoding(df: DataFrame, numeric: list[str], text: list[str]) -> Encoding:
    """Shared passes for all medians, one for mean and deviation after filling, one for all categories of text."""
    medians: dict = {}
    means: dict = {}
    stds: dict = {}
    if numeric:
        medians = {c: q[0] for c, q in exact_quantiles(df, {c: F.col(quoted(c)) for c in numeric}, [0.5]).items()}
        filled = {c: F.coalesce(F.col(quoted(c)).cast("double"), F.lit(medians[c]).cast("double")) for c in numeric}
        got = df.agg(*[F.avg(v).alias(f"a{k}") for k, v in enumerate(filled.values())], *[F.stddev_pop(v).alias(f"s{k}") for k, v in enumerate(filled.values())]).first()
        means = {c: got[f"a{k}"] for k, c in enumerate(numeric)}
        stds = {c: got[f"s{k}"] or 1.0 for k, c in enumerate(numeric)}
    categories: dict[str, list[str]] = {c: [] for c in text}
    if text:
        placed = df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())
        values = F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(quoted(c)), F.lit(f"Unknown_{c}")).alias("v")) for c in text])
        seen = placed.select(ROW_ID, F.explode(values).alias("x")).groupBy("x.c", "x.v").agg(F.min(ROW_ID).alias("at"))
        for r in seen.orderBy("at", "c").collect():
            categories[r["c"]].append(r["v"])
    return Encoding(medians, means, stds, categories)


def encode_and_scale(df: DataFrame, target: str = TARGET, max_categories: int = 50) -> DataFrame:
    """_row_id, scaled numbers, one-hot text, and the target: the columns of X and y side by side."""
    placed = df if ROW_ID in df.columns else with_ordinal(df)
    x = drop_high_cardinality(placed.drop(target, *RAW_ONLY), max_categories)
    fitted = fit_encoding(placed, numeric_columns(x), text_columns(x))
    return placed.select(ROW_ID, *fitted.columns(set(x.columns)), F.col(target))


def model_frame(df: DataFrame, strict: bool = False) -> DataFrame:
    """age, experience and bmi in place of the raw columns, without texts of 50 values or more."""
    made = df.withColumn("__year", X.trailing_year(F.col("version"), strict)).withColumns(
        {"age": X.years_since(F.col("__year"), F.col("b_day")), "experience": X.years_since(F.col("__year"), F.col("draft_year")), "bmi": X.body_mass(F.col("weight"), F.col("height"))}
    )
    return drop_high_cardinality(made.drop("__year", *RAW_ONLY))


def transform_frame(df: DataFrame, target: str = TARGET, max_categories: int = 10_000) -> DataFrame:
    """Scaled numbers and bare-named one-hot text of an engineered table, with the target.

    Text of over ``max_categories`` values is an error, found before any value is fetched.
    """
    placed = df if ROW_ID in df.columns else with_ordinal(df)
    texts = text_columns(placed)
    if wide := [c for c in texts if c not in drop_high_cardinality(placed.select(*[F.col(quoted(c)) for c in texts]), max_categories + 1).columns]:
        raise ValueError(f"over {max_categories} categories: {wide}")
    fitted = fit_encoding(placed, [c for c in numeric_columns(placed) if c != target], texts)
    return placed.select(ROW_ID, *fitted.columns(set(placed.columns), named=False), F.col(target))


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns``, in order: missing ones are 0.0, others go."""
    return df.select(*[F.col(quoted(c)) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


class FittedPreprocessor:
    """Fit on raw records once; ``transform`` is then a projection without any job."""

    def __init__(self, threshold: float = 0.5):
        self.threshold = threshold
        self.feature_columns: list[str] | None = None
        self.encoding: Encoding | None = None

    def fit(self, df: DataFrame) -> FittedPreprocessor:
        featured = model_frame(clean_records(df if ROW_ID in df.columns else with_ordinal(df), strict=True), strict=True)
        kept = drop_collinear(featured, threshold=self.threshold, skip_constant=False)
        self.feature_columns = [c for c in kept.columns if c not in (TARGET, ROW_ID)]
        self.encoding = fit_encoding(kept, [c for c in numeric_columns(kept) if c != TARGET], text_columns(kept))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.encoding is None:
            raise ValueError("fit() comes before transform()")
        made = calendar_features(clean_records(df, strict=True), strict=True)
        keep = [c for c in (ROW_ID, TARGET) if c in made.columns]
        return made.select(*keep, *self.encoding.columns(set(made.columns)))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        placed = df if ROW_ID in df.columns else with_ordinal(df)
        return self.fit(placed).transform(placed)

    def save(self, spark: SparkSession, path: str) -> None:
        """Thresholds, columns and statistics as JSON at ``path``."""
        if self.encoding is None:
            raise ValueError("fit() comes before save()")
        write_json(spark, path, {"threshold": self.threshold, "feature_columns": self.feature_columns, "encoding": asdict(self.encoding)})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedPreprocessor:
        held = read_json(spark, path)
        if held is None:
            raise FileNotFoundError(path)
        out = cls(held["threshold"])
        out.feature_columns, out.encoding = held["feature_columns"], Encoding(**held["encoding"])
        return out
