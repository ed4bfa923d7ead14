"""Flow files to scored unified events and a campaign split, and to identifier training sets."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions.lookup import label_stage
from ..operators import bursts, campaigns, checks, identifier, sampling
from ..operators.ranking import number_rows
from ..session import cut_lineage, release
from ..sources import flows


def _keyed(raw: DataFrame) -> DataFrame:
    """A content key per row: stable across runs and partitionings, unlike a position."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(set(raw.columns) - {"source_file", "day"})]
    return raw.withColumn("row_key", F.concat_ws("#", "source_file", F.md5(F.concat_ws("\x1f", *columns))))


def numbered(raw: DataFrame) -> DataFrame:
    """Unique ids: the content key plus an ordinal among identical rows of a file. Identical rows are
    interchangeable, so the set of ids does not depend on who gets which ordinal."""
    keyed = _keyed(raw)
    copies = keyed.groupBy("row_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        "row_key", F.lit(True).alias("_copied"))
    joined = keyed.join(copies, "row_key", "left")
    single = joined.where("_copied IS NULL").withColumn("copy", F.lit(1).cast("long"))
    # Scan positions split a hot group of copies; fixed by the cut, since they are read twice.
    several = cut_lineage(joined.where("_copied").withColumn("_at", F.monotonically_increasing_id()))
    several = number_rows(several, ["row_key"], F.shiftright("_at", 16), ["_at"], "copy").drop("_at")
    rows = single.unionByName(several).drop("_copied")
    return rows.withColumn("event_id", F.concat_ws("#", "row_key", F.col("copy").cast("string"))).drop("row_key", "copy")


def benign_rows(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("source_file").isin(flows.benign_files()))


def attack_rows(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("source_file").isin(flows.attack_files()))


def _written_rows(raw: DataFrame) -> DataFrame:
    """``numbered(raw)`` as a written table; text is parsed once, every later pass reads columns."""
    parsed = cut_lineage(raw)
    rows = cut_lineage(numbered(parsed))
    release(parsed)
    return rows


def flow_events(raw: DataFrame, model: PipelineModel, compat=False, gap_minutes=S.CAMPAIGN_GAP_MINUTES,
                threshold=S.BURST_THRESHOLD, benign_budget: dict = None) -> DataFrame:
    """Unified events with predictions: attacks labelled by time gaps, floods collapsed. All benign rows
    stay; ``benign_budget`` (options of ``sampling.benign_quota``) samples them per day before they are scored."""
    features = flows.feature_columns(raw)
    rows = _written_rows(raw)
    attacks, benign = attack_rows(rows), benign_rows(rows)
    if benign_budget is not None:
        per_day = lambda df: df.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
        per_file = benign.groupBy("source_file", "day").agg(F.count(F.lit(1)).alias("n"))
        quota = sampling.benign_quota(per_day(attacks), per_file, ["day"], **benign_budget)
        benign = sampling.exact_sample(benign, ["source_file"], quota)

    light = S.FLOW_LIGHT_COLUMNS + ["event_id", "source_file", "day"]
    score = lambda df: identifier.score_events(model, flows.clean_features(df, features), light)
    attacks = campaigns.label_by_time_gaps(score(attacks), gap_minutes=gap_minutes).withColumns({
        "is_campaign_link": F.lit(True), "attack_type": F.col("label"),
        "kill_chain_stage": label_stage(F.col("label"), compat)})
    benign = score(benign).withColumns({
        "campaign_id": F.lit(S.NO_CAMPAIGN), "is_campaign_link": F.lit(False), "attack_type": F.lit("benign"),
        "kill_chain_stage": F.lit(S.UNKNOWN_STAGE)})
    combined = attacks.unionByName(benign).withColumns({
        "source_dataset": F.lit("cicids2017"), "tier": F.lit("network"), "vantage": F.lit("N/A"),
        "service": F.col("protocol"), "src_port": F.col("src_port").cast("double"), "dst_port": F.col("dst_port").cast("double")})
    collapsed = bursts.aggregate_bursts(cut_lineage(combined), ["campaign_id", "attack_type"], threshold)
    if "predicted_attack_type_agreement" not in collapsed.columns:
        collapsed = collapsed.withColumn("predicted_attack_type_agreement", F.lit(1.0))
    staged = collapsed.withColumn("predicted_kill_chain_stage", label_stage(F.col("predicted_attack_type"), compat))
    return staged.select(*S.UNIFIED_COLUMNS, *S.FLOW_EXTRAS.fieldNames())


def checked_split(events: DataFrame, seed=S.SEED, manifest: DataFrame = None) -> DataFrame:
    """Campaign split, refused when a campaign stands on both sides or a test-only source is present."""
    split = sampling.campaign_split(events, seed=seed, manifest=manifest)
    checks.assert_no_campaign_leakage(sampling.rows_of_split(events, split, "train"),
                                      sampling.rows_of_split(events, split, "val"), context="train/val")
    checks.assert_no_test_only_rows(events, context="training events")
    return split


def identifier_sets(raw: DataFrame, target=S.BENIGN_TOTAL_TARGET, floor=S.BENIGN_FLOOR):
    """(train, test, features), cut by time within each file. ``target`` and ``floor`` bound the benign rows
    that the model is fitted on; the test side is whole."""
    features = flows.feature_columns(raw)
    rows = _written_rows(raw)
    listed = attack_rows(rows).unionByName(benign_rows(rows))
    split = cut_lineage(sampling.chronological_split(flows.clean_features(listed, features), ["source_file"]))
    release(rows)
    side = lambda name: split.where(F.col("split") == name).drop("split")
    benign = benign_rows(side("train"))
    quota = sampling.proportional_quota(flows.rows_per_file(benign), target, floor)
    train = attack_rows(side("train")).unionByName(sampling.exact_sample(benign, ["source_file"], quota))
    return cut_lineage(train), side("test"), features


def second_flow_study(train: DataFrame, test: DataFrame, **options) -> DataFrame:
    """Ablation of the time-to-live columns on the dataset's own split."""
    features = [c for c in train.columns if c not in S.SECOND_FLOW_NON_FEATURES]
    return identifier.column_ablation(train, test, features, S.SECOND_FLOW_TTL_COLUMNS, "attack_cat",
                                      S.SECOND_FLOW_CATEGORICAL, **options)
