"""Observation files: line-delimited JSON, strict, nothing skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGMA = "struct<basis:string,sigma_deg:double,assumption:struct<declared_by:string,note:string>,method:string>"
_HEIGHT = "struct<basis:string,sigma_m:double,assumption:struct<declared_by:string,note:string>,method:string>"
SCHEMA = f"""schema string, kind string, observation_id string, source_id string, sensor_id string, t string, t_start string, t_end string, t_uncertainty_s double,
freq_hz double, freq_sigma_hz double, bandwidth_hz double, power_dbm double, snr_db double, duration_s double, modulation_hint string, transmission_id string, transmission_state string, power_saturated boolean,
hop struct<group_id:string,dwell_s:double>, source_claim struct<scheme:string,category:string,claimed_id:string>,
provenance struct<adapter:string,adapter_version:string,contract:string,conversions:array<struct<kind:string,detail:string>>>,
sensor_lat double, sensor_lon double, sensor_alt_m double, bearing_deg double, bearing_uncertainty {_SIGMA}, elevation_deg double, elevation_uncertainty {_SIGMA},
lat double, lon double, alt_m double, alt_uncertainty {_HEIGHT},
position_uncertainty struct<basis:string,cov_en_m2:struct<ee:double,en:double,nn:double>,ellipse:struct<semi_major_m:double,semi_minor_m:double,orientation_deg:double,confidence:double>,assumption:struct<declared_by:string,note:string>,method:string>,
band struct<min_hz:double,max_hz:double>, dwell_s double, revisit_s double, noise_floor_dbm double, occupied_fraction double"""
UTC = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"

#: The fields of each kind of record, and the names that the contract lists.
COMMON = "schema kind observation_id source_id sensor_id provenance meta".split()
SIGNAL = "t t_uncertainty_s freq_hz freq_sigma_hz bandwidth_hz power_dbm snr_db duration_s modulation_hint transmission_id transmission_state power_saturated hop source_claim".split()
OWN = {
    "bearing": [*SIGNAL, *"sensor_lat sensor_lon sensor_alt_m bearing_deg bearing_uncertainty elevation_deg elevation_uncertainty".split()],
    "position": [*SIGNAL, *"lat lon position_uncertainty alt_m alt_uncertainty".split()],
    "coverage": "t_start t_end band dwell_s revisit_s sensor_lat sensor_lon sensor_alt_m".split(),
    "occupancy": "t band noise_floor_dbm occupied_fraction power_dbm sensor_lat sensor_lon sensor_alt_m".split(),
}
REQUIRED = {
    "bearing": "t freq_hz bandwidth_hz provenance sensor_lat sensor_lon bearing_deg bearing_uncertainty".split(),
    "position": "t freq_hz bandwidth_hz provenance lat lon position_uncertainty".split(),
    "coverage": "t_start t_end band provenance".split(),
    "occupancy": "t band noise_floor_dbm provenance".split(),
}
BASES, SCHEMES, STATES = ("measured", "assumed", "unreported"), ("remote_id", "ads_b", "ais", "other"), ("complete", "ongoing")
CONVERSIONS = ("magnetic_to_true", "platform_relative_to_true", "datum", "clock_offset", "unit", "uncertainty_relabel", "other")
NUMBERS = [f.split()[0] for f in SCHEMA.replace("\n", " ").split(", ") if f.endswith(" double")]


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: origin, text, the typed record and its issues; a line that is no JSON is a row with an issue."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return with_issues(lines)


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_jsonl``, with each line's number and file:line as its origin; a file is one row until it is cut into lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    numbered = whole.where(F.trim("text") != "").withColumn("line", F.col("line") + 1)
    return with_issues(numbered.withColumn("origin", F.concat_ws(":", "file", F.col("line").cast("string"))))


def stream_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files as they are dropped into a folder, judged like those of a file: what a sender is told is wrong is a filter of it."""
    return with_issues(spark.readStream.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")))


def delivery_order(judged: DataFrame) -> DataFrame:
    """Lines in the order of delivery: those whose field ``t`` gives no time first, then by time and line."""
    return judged.orderBy(F.try_to_timestamp("r.t").asc_nulls_first(), "file", "line")


def with_issues(lines: DataFrame) -> DataFrame:
    """Parse the column ``text`` and judge it: JSON, contract, kind (each of these ends the judgement), then every rule of the kind."""
    parsed = F.from_json("text", SCHEMA + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "allowNonNumericNumbers": "false"})
    r = lines.withColumn("r", parsed).withColumn("keys", F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>")))
    rec = lambda c: F.col(f"r.{c}")
    no = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), F.lit(text))
    is_kind = lambda *k: rec("kind").isin(*k)
    has = lambda c: F.array_contains("keys", c)
    broken = rec("_corrupt").isNotNull() | rec("kind").isNull() & (F.size("keys") == 0)
    bad_time = lambda c: rec(c).isNotNull() & (~rec(c).rlike(UTC) | F.try_to_timestamp(rec(c)).isNull())
    names = lambda some: F.array(*[F.lit(x) for x in some])
    of_kind = lambda table: F.coalesce(*[F.when(is_kind(k), names(v)) for k, v in table.items()])
    unknown = F.array_sort(F.array_except("keys", of_kind({k: [*COMMON, *v] for k, v in OWN.items()})))
    missing = F.array_sort(F.array_except(of_kind(REQUIRED), "keys"))
    each = lambda found, text: F.transform(found, lambda x: F.concat(F.lit("/"), x, F.lit(text)))

    def uncertainty(path: str, sigma: Column) -> list[Column]:
        u, basis = rec(path).isNotNull(), rec(f"{path}.basis")
        return [
            no(u & (basis.isNull() | ~basis.isin(*BASES)), f"/{path}/basis is not a known basis"),
            no((basis == "unreported") & sigma, f"/{path} unreported with a number"),
            no((basis == "assumed") & rec(f"{path}.assumption.note").isNull(), f"/{path}/assumption is missing"),
        ]

    def angle(path: str) -> list[Column]:
        return [*uncertainty(path, rec(f"{path}.sigma_deg").isNotNull()), no(rec(f"{path}.basis").isin("measured", "assumed") & rec(f"{path}.sigma_deg").isNull(), f"/{path}/sigma_deg is missing"), no(~(rec(f"{path}.sigma_deg") > 0), f"/{path}/sigma_deg is not above 0")]

    cov, ellipse, both = rec("position_uncertainty.cov_en_m2"), rec("position_uncertainty.ellipse"), "/position_uncertainty"
    ee, en, nn = (rec(f"position_uncertainty.cov_en_m2.{c}") for c in ("ee", "en", "nn"))
    basis = rec("position_uncertainty.basis")
    checks = [
        *[no(F.abs(rec(n)) == float("inf"), f"/{n} is not finite") for n in NUMBERS],
        no(bad_time("t"), "/t is not a UTC time"),
        no(bad_time("t_start") | bad_time("t_end"), "/t_start or /t_end is not a UTC time"),
        no(F.try_to_timestamp(rec("t_end")) < F.try_to_timestamp(rec("t_start")), "/t_end t_end is before t_start"),
        *[no(~(rec(n) > 0), f"/{n} is not above 0") for n in ("freq_hz", "bandwidth_hz", "t_uncertainty_s", "freq_sigma_hz")],
        no(rec("duration_s") < 0, "/duration_s is below 0"),
        no((rec("bearing_deg") < 0) | (rec("bearing_deg") >= 360), "/bearing_deg is not in [0, 360)"),
        no(F.abs(rec("elevation_deg")) > 90, "/elevation_deg is not in [-90, 90]"),
        no(has("elevation_deg") != has("elevation_uncertainty"), "/elevation_uncertainty and elevation_deg come together"),
        no(has("alt_m") != has("alt_uncertainty"), "/alt_uncertainty and alt_m come together"),
        *angle("bearing_uncertainty"),
        *angle("elevation_uncertainty"),
        *uncertainty("alt_uncertainty", rec("alt_uncertainty.sigma_m").isNotNull()),
        *uncertainty("position_uncertainty", F.lit(False)),
        no((basis == "unreported") & (cov.isNotNull() | ellipse.isNotNull()), f"{both} unreported with a region"),
        no((basis != "unreported") & (cov.isNull() == ellipse.isNull()), f"{both} has not exactly one of cov_en_m2 and ellipse"),
        no((ee < 0) | (nn < 0) | (ee * nn - en * en < -1e-6), f"{both} covariance is not positive semi-definite"),
        no(rec("position_uncertainty.ellipse.semi_minor_m") > rec("position_uncertainty.ellipse.semi_major_m"), f"{both} semi_minor_m is larger than semi_major_m"),
        no(ellipse.isNotNull() & ~F.coalesce((rec("position_uncertainty.ellipse.confidence") > 0) & (rec("position_uncertainty.ellipse.confidence") < 1), F.lit(False)), f"{both}/ellipse/confidence is missing"),
        no(rec("band.min_hz") > rec("band.max_hz"), "/band min_hz is greater than max_hz"),
        no(rec("dwell_s") > rec("revisit_s"), "/dwell_s dwell_s is longer than revisit_s"),
        no(has("dwell_s") != has("revisit_s"), "/revisit_s and dwell_s come together"),
        no(~rec("occupied_fraction").between(0, 1), "/occupied_fraction is not in [0, 1]"),
        no(rec("transmission_state").isNotNull() & ~rec("transmission_state").isin(*STATES), "/transmission_state is not a known state"),
        no(rec("source_claim").isNotNull() & ~F.coalesce(rec("source_claim.scheme").isin(*SCHEMES), F.lit(False)), "/source_claim/scheme is not a known scheme"),
        no(rec("provenance.contract") != "observation.v1", "/provenance/contract is another contract"),
        no(F.exists(rec("provenance.conversions"), lambda c: ~F.coalesce(c["kind"].isin(*CONVERSIONS), F.lit(False))), "/provenance/conversions kind is not a known kind"),
    ]
    rules = F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), each(unknown, " is unknown"), each(missing, " is missing"))
    one = lambda text: F.array(F.lit(text))
    issues = (
        F.when(broken, one("/ is not JSON of this contract"))
        .when(rec("schema").isNull() | (rec("schema") != "observation.v1"), one("/schema is not this contract"))
        .when(rec("kind").isNull() | ~is_kind(*OWN), one("/kind is not a known kind"))
        .otherwise(F.array_sort(F.array_distinct(rules)))
    )
    # judged once: a column that is not deterministic is not copied into the filters on it
    once = issues if lines.isStreaming else F.when(F.monotonically_increasing_id() >= 0, issues)
    return r.withColumn("issues", once).drop("keys")
