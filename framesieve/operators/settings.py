"""Rules for configurations, profiles and capture targets, as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesieve.functions.scalar import first_failure

# The texts of rules, and the order in which rules are tried.

_say = F.lit


def _text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def config_error() -> Column:
    """First broken rule of a session configuration row, else null."""
    c = F.col
    names = F.coalesce(F.size("channel_map"), F.lit(0))
    return first_failure([
        (c("config_version") != 1, _text("configVersion ", c("config_version"), " is not supported; expected 1")),
        (F.trim("user") == "", _say("user must be non-empty")),
        (~c("backend").isin("pipewire", "fake"), _say("backend must be pipewire or fake")),
        (c("seconds") == 0, _say("seconds must be > 0")),
        (c("sample_rate") == 0, _say("sampleRate must be > 0")),
        (c("channels") == 0, _say("channels must be > 0")),
        ((names > 0) & (names != c("channels")), _text("channelMap length ", names, " must match channels ", c("channels"))),
        (c("sample_format") != "F32LE", _text("sampleFormat ", c("sample_format"), " is unsupported in v0.2; expected F32LE")),
        (~c("output_dir").startswith("/"), _say("outputDir must be absolute in daemon config")),
        ((c("headroom") < 1) | F.isnan("headroom") | (c("headroom") == float("inf")), _say("memory.headroom must be finite and >= 1.0")),
        (c("max_active_snapshots") == 0, _say("maxActiveSnapshots must be > 0")),
        (c("chunk_frames") == 0, _say("chunkFrames must be > 0")),
        (c("control_permissions") != "0600", _say("controlPermissions must be 0600 in v0.2")),
        (c("export_mode") != "per-channel", _say("export.mode must be per-channel")),
        (c("export_format") != "wav", _say("export.format must be wav")),
        ((c("split_when_over_bytes") == 0) | (c("split_when_over_bytes") >= 4000000000), _say("export.splitWhenOverBytes must be between 1 and 3999999999")),
    ])


def profile_error() -> Column:
    """First broken rule of a profile row, else null: backend, client, ports (jack), then the common ones."""
    c = F.col
    jack, ports, sources = c("backend") == "jack", F.coalesce(F.size("ports"), F.lit(0)), F.coalesce(F.size("sources"), F.lit(0))
    blank = lambda a: F.coalesce(F.exists(c(a), lambda x: F.trim(x) == ""), F.lit(False))
    return first_failure([
        (c("backend").isNull() | ~c("backend").isin("jack", "pipewire"), _say("backend must be jack or pipewire")),
        (jack & (F.trim(F.coalesce("client_name", F.lit(""))) == ""), _say("clientName is required")),
        (jack & (ports > 0) & (sources > 0), _say("ports and sources are exclusive")),
        (jack & (blank("ports") | blank("sources")), _say("a port source must be non-empty")),
        (jack & (ports == 0) & (sources == 0), _say("ports or sources are required")),
        (F.coalesce("seconds", F.lit(0)) <= 0, _say("buffer.seconds must be > 0")),
        (c("output_dir").isNull() | ~c("output_dir").startswith("/"), _say("outputDir must be absolute")),
        (c("export_mode") != "per-channel", _say("export.mode must be per-channel")),
        (c("export_format") != "wav", _say("export.format must be wav")),
    ])


def app_error() -> Column:
    return F.when(F.coalesce(F.col("start_mode"), F.lit("manual")).isin("manual", "auto"), F.lit(None).cast("string")).otherwise(_text("startMode must be manual or auto, not ", F.col("start_mode")))


def ports(profiles: DataFrame, key: str) -> DataFrame:
    """(key, position, name, source): ports by name, or plain sources named ch01, ch02, ..."""
    named = F.col("_s.name")
    rows = profiles.select(key, F.posexplode("ports").alias("position", "_s"))
    return rows.select(key, "position", F.coalesce(named, F.format_string("ch%02d", F.col("position") + 1)).alias("name"), F.col("_s.source").alias("source"))


def active_profile(requests: DataFrame, profiles: DataFrame, name: str = "name") -> DataFrame:
    """Left join of the trimmed name; blank is none, an unknown one an error text."""
    wanted = F.nullif(F.trim(F.col("active")), F.lit(""))
    both = requests.withColumn("_w", wanted).join(profiles.withColumn("_n", F.col(name)), F.col("_w") == F.col("_n"), "left")
    return both.withColumn("error", F.when(F.col("_w").isNotNull() & F.col("_n").isNull(), _text("profile ", F.col("_w"), " does not exist"))).drop("_w", "_n")


def input_source(object_type="object_type", media_class="media_class", name="name", description="description") -> Column:
    """Nodes that can be recorded; monitors of outputs can't."""
    c = F.col
    return (
        (c(object_type) == "Node")
        & c(media_class).isin("Audio/Source", "Audio/Input")
        & ~F.coalesce(c(name).endswith(".monitor"), F.lit(False))
        & ~F.coalesce(F.lower(c(description)).contains("monitor"), F.lit(False))
    )


def matches(target: Column) -> Column:
    """By number, exact name or exact description."""
    return (F.col("id").cast("string") == target) | (F.col("name") == target) | (F.col("description") == target)


def resolve(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request (request, target): the node's id, or the error.

    With a target the first matching node (by number, name or description), which must
    be a source; without one the first source.  First is by ``position``.  Requests meet
    nodes by equal keys; the first source is a scalar.
    """
    own = nodes.select("id", "position", input_source().alias("good"), F.explode(F.array_distinct(F.array(F.col("id").cast("string"), "name", "description"))).alias("key"))
    first = nodes.where(input_source()).agg(F.min_by("id", "position")).scalar()
    found = own.groupBy("key").agg(F.min_by("id", "position").alias("named"), F.min_by("good", "position").alias("good"))
    best = requests.join(found, F.col("target") == F.col("key"), "left").withColumn("id", F.when(F.col("target").isNull(), first).otherwise(F.col("named")))
    error = (
        F.when(F.col("id").isNull() & F.col("target").isNull(), _say("no input source available"))
        .when(F.col("id").isNull(), _text("target ", F.col("target"), " not found"))
        .when(F.col("target").isNotNull() & ~F.col("good"), _text("target ", F.col("target"), " is not an input source"))
    )
    return best.select("request", "target", F.when(error.isNull(), F.col("id")).alias("id"), error.alias("error"))


def resolved_stream(rows: DataFrame) -> DataFrame:
    """Stream facts of a node over those of the configuration: channels, rate, format, or the error."""
    channels, rate = F.coalesce("node_channels", "config_channels"), F.coalesce("node_rate", "config_rate")
    kind, names = F.coalesce("node_format", F.lit("F32LE")), F.coalesce(F.size("channel_map"), F.lit(0))
    error = first_failure([
        (channels.isNull() | (channels == 0), _say("channels unknown")),
        ((names > 0) & (names != channels), _text("channelMap length ", names, " must match channels ", channels)),
        (rate.isNull() | (rate == 0), _say("sample rate unknown")),
        (kind != "F32LE", _text("format ", kind, " is unsupported")),
    ])
    return rows.withColumn("channels", channels).withColumn("sample_rate", rate).withColumn("format", kind).withColumn("error", error)
