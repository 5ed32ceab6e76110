"""Scans: raw sample buffers, a deterministic test signal, WAV files, node and TOML tables."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesieve.shipping import ship


def raw_buffer_error(data: str = "data", offset: str = "offset", size: str = "size", stride: str = "stride", channels: str = "channels") -> Column:
    """First broken rule of a raw buffer row, else null."""
    c = F.col
    return (
        F.when(c(channels) <= 0, "channels must be > 0")
        .when(c(stride) != c(channels) * 4, "stride must be 4 bytes a channel")
        .when(c(size) % c(stride) != 0, "size must be whole frames")
        .when((c(offset) < 0) | (c(size) < 0), "offset and size must not be negative")
        .when(c(offset).cast("bigint") + c(size).cast("bigint") > F.length(c(data)), "range lies outside the buffer")
        .when(c(offset) % 4 != 0, "samples must be 4-byte aligned")
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _floats(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def raw_buffers(rows: DataFrame, data: str = "data", offset: str = "offset", size: str = "size") -> DataFrame:
    """Rows with ``samples`` (little-endian FLOATs of the valid range) and ``error``; one of them is null.

    The range is cut in the JVM; only valid bytes go through Arrow.
    """
    ship(rows.sparkSession)
    checked = rows.withColumn("error", raw_buffer_error(data, offset, size))
    cut = F.when(F.col("error").isNull(), F.substring(F.col(data), F.col(offset).cast("int") + 1, F.col(size).cast("int")))
    return checked.withColumn("samples", _floats(cut))


def _saw(start: float) -> list[float]:
    """Samples from ``start`` in FLOAT steps of 0.001 until one exceeds 1."""
    steps = np.full(4001, np.float32(0.001), np.float32)
    steps[0] = start
    ramp = np.add.accumulate(steps, dtype=np.float32)
    return ramp[: int(np.argmax(ramp > 1.0)) + 1].tolist()[:-1]


def signal_samples(frame: Column, channels: int = 1) -> Column:
    """Samples of a frame of the test signal: a saw that starts at 0 and falls to -1 after exceeding 1, one step a sample.

    The ramp repeats, so sample k is a look-up in one period: any partition can
    make its frames alone.
    """
    first, period = _saw(0.0), _saw(-1.0)
    ramp = lambda xs: F.lit(np.array(xs, np.float32)).cast("array<float>")
    k = lambda c: frame * channels + c
    value = lambda c: F.when(k(c) < len(first), F.get(ramp(first), k(c).cast("int"))).otherwise(F.get(ramp(period), F.pmod(k(c) - len(first), F.lit(len(period)).cast("bigint")).cast("int")))
    return F.array(*(value(c) for c in range(channels)))


def test_signal(spark: SparkSession, frames: int, channels: int = 1) -> DataFrame:
    """(frame, samples) of the test signal."""
    return spark.range(frames).select(F.col("id").alias("frame"), signal_samples(F.col("id"), channels).alias("samples"))


_WAV = "path string, channels int, sample_rate int, bits int, data_bytes long, samples array<int>"


def wav_files(spark: SparkSession, folder: str) -> DataFrame:
    """Mono or stereo 24-bit WAV files of a folder: header fields and integer samples."""

    ship(spark)

    def decode(batches):
        for pdf in batches:
            out = []
            for path, b in zip(pdf["path"], pdf["content"], strict=True):
                if b[:4] != b"RIFF" or b[8:16] != b"WAVEfmt " or b[36:40] != b"data":
                    raise ValueError(f"{path} is not a plain WAV file")
                n = int.from_bytes(b[40:44], "little")
                raw = np.frombuffer(b[44 : 44 + n], np.uint8).reshape(-1, 3).astype(np.int32)
                q = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
                out.append((path, int.from_bytes(b[22:24], "little"), int.from_bytes(b[24:28], "little"), int.from_bytes(b[34:36], "little"), n, np.where(q >= 1 << 23, q - (1 << 24), q)))
            yield pd.DataFrame(out, columns=["path", "channels", "sample_rate", "bits", "data_bytes", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(decode, _WAV)


def load_toml(path: str) -> tuple[dict, str | None]:
    """(document, error): a missing file is an empty document, a broken one empty with its error."""
    try:
        return tomllib.loads(Path(path).read_text()), None
    except FileNotFoundError:
        return {}, None
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        return {}, f"failed to parse {path}: {e}"


def is_runtime_config(text: str) -> bool:
    """Whether a document configures one fixed session: it has the key configVersion, parsed or not."""
    try:
        return "configVersion" in tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return any(line.lstrip().startswith("configVersion") for line in text.splitlines())


def config_path(app: str, environ: dict | None = None) -> Path:
    env = os.environ if environ is None else environ
    base = env.get("XDG_CONFIG_HOME") or (env["HOME"] + "/.config" if env.get("HOME") else None)
    if not base:
        raise ValueError("neither XDG_CONFIG_HOME nor HOME is set")
    return Path(base) / app / f"{app}.toml"


def write_default_config(path: str, text: str, force: bool = False) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w" if force else "x") as f:
        f.write(text)


def runtime_parameters(document: dict) -> dict:
    """Queue, stack and limit settings: a fixed session's own, else the defaults."""
    own = document.get("memory", {}) if "configVersion" in document else {}
    return {"headroom": own.get("headroom", 1.2), "max_bytes": own.get("maxBytes"), "queue_slots": 64, "control_slots": 16, "stack": 512 << 10, "io": 64 << 10, "path": 4096, "split": document.get("export", {}).get("splitWhenOverBytes", 3_900_000_000)}
