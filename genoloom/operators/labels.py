"""Curated regulator-target records from several resources brought into one table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import title

# Source column -> curated column, where present.
RENAMES = {
    "tf": "tf_symbol",
    "target": "target_symbol",
    "species_name": "tf_species",
    "experiment": "experiment_type",
    "source_list": "databases",
}


def build_table(records: DataFrame, source: str) -> DataFrame:
    """Rename the columns that are present, title-case the species, tag the source."""
    out = records.withColumnsRenamed(RENAMES)
    return out.withColumn("tf_species", title("tf_species")).withColumn("source", F.lit(source))


def join_records(curated: DataFrame, extra: DataFrame, key: str = "record_id") -> DataFrame:
    """Left join by record; columns that both have (also under their curated name) come from the left."""
    extra = extra.withColumnsRenamed(RENAMES)
    new = [c for c in extra.columns if c == key or c not in curated.columns]
    return curated.join(extra.select(*new), key, "left")


def known_genes(curated: DataFrame, tf_names: DataFrame, gene_ref: DataFrame) -> DataFrame:
    """Regulator in either species' regulator list and target in either species' gene list."""
    tfs = tf_names.select(F.upper("symbol").alias("_k")).distinct()
    genes = gene_ref.select(F.upper("symbol").alias("_k")).distinct()
    out = curated.join(tfs, F.upper("tf_symbol") == F.col("_k"), "left_semi")
    return out.join(genes, F.upper("target_symbol") == F.col("_k"), "left_semi")


def species_casing(curated: DataFrame) -> DataFrame:
    """Symbols of mouse records in title case."""
    mouse = F.col("tf_species") == "Mouse"
    fix = lambda c: F.when(mouse, title(c)).otherwise(F.col(c))
    return curated.withColumns({"tf_symbol": fix("tf_symbol"), "target_symbol": fix("target_symbol")})


def infer_species(records: DataFrame, gene_ref: DataFrame, source: str) -> DataFrame:
    """Human if the regulator symbol is in the human gene list, else mouse."""
    human = gene_ref.filter("species = 'Human'").select(F.col("symbol").alias("tf_symbol"), F.lit("Human").alias("_s"))
    out = records.withColumnsRenamed(RENAMES).join(human, "tf_symbol", "left")
    return out.withColumn("tf_species", F.coalesce("_s", F.lit("Mouse"))).drop("_s").withColumns({"source": F.lit(source), "databases": F.lit(source)})


def append_and_exclude(first: DataFrame, second: DataFrame, only_tf: str, only_source: str, targets: list[str], source_col: str = "databases") -> DataFrame:
    """Union of both tables, with two rules for one regulator.

    Records of ``only_tf`` (as written) stay only if their source list contains ``only_source``; the
    self pair stays in any case. Records of ``only_tf`` (any case) with one of the ``targets``
    (upper case) go. Other regulators keep all their records. A missing source list contains nothing.
    """
    rows = first.unionByName(second, allowMissingColumns=True)
    tf, target = F.upper("tf_symbol"), F.upper("target_symbol")
    own = tf == only_tf.upper()
    elsewhere = (F.col("tf_symbol") == only_tf) & ~F.coalesce(F.contains(F.col(source_col), F.lit(only_source)), F.lit(False)) & ~(own & (target == only_tf.upper()))
    return rows.filter(~F.coalesce(elsewhere, F.lit(False)) & ~F.coalesce(own & target.isin(targets), F.lit(False)))


# Text (lower case) that an experiment's description contains, and its class; the first that fits holds.
EXPERIMENT_CLASSES = (("perturbation", "Perturbation"), ("bindin", "Binding"), ("reporte", "Reporter"))


def experiment_class(curated: DataFrame, classes: tuple[tuple[str, str], ...] = EXPERIMENT_CLASSES) -> DataFrame:
    """Class of the experiment by the text it contains; anything else, also a missing text, is the string NA."""
    text = F.lower("experiment_type")
    first = F.coalesce(*[F.when(F.contains(text, F.lit(part)), F.lit(name)) for part, name in classes], F.lit("NA"))
    return curated.withColumn("experiment_class", first)


def targets_per_tf(curated: DataFrame, min_targets: int) -> DataFrame:
    pairs = curated.select(F.upper("tf_symbol").alias("tf"), F.upper("target_symbol").alias("target")).distinct()
    return pairs.groupBy("tf").agg(F.count(F.lit(1)).alias("n_targets")).filter(F.col("n_targets") >= min_targets)


def without_ortholog(curated: DataFrame, ortho: DataFrame) -> DataFrame:
    targets = curated.select("target_symbol").distinct()
    for c in ("symbol_hg", "symbol_mm"):
        targets = targets.join(ortho.select(F.col(c).alias("target_symbol")), "target_symbol", "left_anti")
    return targets
