"""Sequence discovery, audits and catalogue work over file, frame and log listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import as_col, big, finite
from ..functions.names import channel_rule_rank


def list_files(spark, root: str) -> DataFrame:
    """Path and length of every file under a folder; contents are never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select("path", F.col("length").alias("bytes")))


def parse_sequence_path(path: Column) -> Column:
    """dir, prefix, number, padding, suffix of a numbered .exr path; null if it is not one."""
    name = F.substring_index(path, "/", -1)
    stem = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    suffix = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    digits = F.regexp_extract(stem, r"([0-9]+)$", 1)
    ok = (F.lower(suffix) == ".exr") & (F.length(digits) > 0)
    return F.when(ok, F.struct(
        F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("dir"),
        F.substring(stem, F.lit(1), F.length(stem) - F.length(digits)).alias("prefix"),
        digits.cast("bigint").alias("number"),
        F.length(digits).alias("padding"),
        suffix.alias("suffix"),
    ))


def discover_sequences(paths: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """Files of every numbered sequence in frame order.

    A sequence is (dir, prefix); its first frame is the given one or the lowest number found, and
    files below it, or with fewer digits than it, are left out.
    """
    seq = W.partitionBy("dir", "prefix")
    parsed = paths.select("path", parse_sequence_path(F.col("path")).alias("p")).where("p IS NOT NULL").select(
        "path", "p.*")
    if first is None:
        parsed = parsed.withColumn("head", F.min(F.struct("number", "padding")).over(seq)).select(
            "*", F.col("head.number").alias("first_number"), F.col("head.padding").alias("first_padding")).drop("head")
    else:
        heads = first.select(parse_sequence_path(F.col("path")).alias("p")).where("p IS NOT NULL").select(
            F.col("p.dir").alias("dir"), F.col("p.prefix").alias("prefix"), F.col("p.number").alias("first_number"),
            F.col("p.padding").alias("first_padding"))
        parsed = parsed.join(heads, ["dir", "prefix"])
    return parsed.where("number >= first_number AND padding >= first_padding").withColumn(
        "ordinal", big(F.row_number().over(seq.orderBy("number", "path"))))


def expected_path(dir_: Column, prefix: Column, first_number: Column, padding: Column, suffix: Column,
                  offset: Column) -> Column:
    """Path of a zero-based frame offset; numbers wider than the padding are kept whole."""
    n = (first_number + offset).cast("string")
    padded = F.when(F.length(n) >= padding, n).otherwise(
        F.concat(F.repeat(F.lit("0"), (padding - F.length(n)).cast("int")), n))
    return F.concat(dir_, F.lit("/"), prefix, padded, suffix)


def needed_offset(frame_no: Column, direction: str) -> Column:
    """Zero-based file offset a 1-based frame reads."""
    return frame_no - (1 if direction == "current_to_previous" else 2)


def missing_frames(clips: DataFrame, seqs: DataFrame, files: DataFrame, direction: str = "current_to_previous") -> DataFrame:
    """Frames of every clip whose guidance file is absent.

    clips(clip_id, total_frames), seqs(clip_id, dir, prefix, first_number, padding, suffix), files(path).
    """
    frames = clips.select("clip_id", F.explode(F.sequence(F.lit(1).cast("bigint"), big("total_frames"))).alias("frame_no"))
    wanted = frames.withColumn("offset", needed_offset(F.col("frame_no"), direction)).where("offset >= 0")
    wanted = wanted.join(seqs, "clip_id").select(
        "clip_id", "frame_no",
        expected_path(F.col("dir"), F.col("prefix"), F.col("first_number"), F.col("padding"), F.col("suffix"),
                      F.col("offset")).alias("path"))
    return wanted.join(files.select("path"), "path", "left_anti").select("clip_id", "frame_no", "path")


def even_sample(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """k evenly spaced rows per group (all rows when the group has no more than k, or k <= 1).

    Each row decides by itself whether one of the k target positions rounds to it, so the only
    shuffle is the window's.
    """
    w = W.partitionBy(*group)
    d = df.withColumn("_rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    if k <= 1:
        return d.drop("_rn", "_n")
    # i = round(rn * (k-1) / (n-1)) is the only candidate target for row rn.
    i = F.round(F.col("_rn") * (k - 1) / (F.col("_n") - 1))
    hit = F.round(i * (F.col("_n") - 1) / F.lit(float(k - 1))) == F.col("_rn")
    return d.where((F.col("_n") <= k) | hit).drop("_rn", "_n")


def on_stride(width, height, max_values: int, y: str = "y", x: str = "x") -> Column:
    """True for every max(1, n / max_values)-th cell of a plane in row-major order."""
    n = as_col(width) * as_col(height)
    stride = F.greatest(F.lit(1), F.floor(n / F.lit(float(max_values))))
    return (F.col(y) * as_col(width) + F.col(x)) % stride == 0


def stride_sample_finite(df: DataFrame, value: str, width, height, max_values: int) -> DataFrame:
    """The finite values among a plane's stride sample."""
    return df.where(on_stride(width, height, max_values) & finite(F.col(value)))


def align_guidance(frames: DataFrame, fields: DataFrame, value_cols: list[str], direction: str,
                   required: bool = False) -> DataFrame:
    """Attach to each frame cell the guidance file it reads; optional guidance is zero where absent.

    ``frame_no`` of ``fields`` is the 1-based position of the file in its sequence. With
    ``required`` a missing cell stays null, so that ``missing_frames`` can report it.
    """
    shift = 0 if direction == "current_to_previous" else 1
    cells = [c for c in ("clip_id", "frame_no", "y", "x") if c in fields.columns]
    f = fields.select(*[c for c in cells if c != "frame_no"], (F.col("frame_no") + shift).alias("frame_no"), *value_cols)
    out = frames.join(f, cells, "left")
    if required:
        return out
    return out.select(*[c for c in out.columns if c not in value_cols],
                      *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in value_cols])


def validate_dimensions(fields: DataFrame, clips: DataFrame) -> DataFrame:
    """One row per (clip, frame) whose field does not have the clip's dimensions, or whose clip is unknown."""
    got = fields.groupBy("clip_id", "frame_no").agg(
        big(F.max("x") + 1).alias("got_width"), big(F.max("y") + 1).alias("got_height"),
        F.count(F.lit(1)).alias("cells"))
    # One row per frame against one row per clip; the optimiser broadcasts clips when it is small.
    j = got.join(clips.select("clip_id", "width", "height"), "clip_id", "left")
    return j.where("width IS NULL OR height IS NULL OR got_width <> width OR got_height <> height OR cells <> width * height")


def validate_depth_range(mapping: Column, near: Column, far: Column) -> Column:
    """Null when the depth settings are usable, otherwise what is wrong."""
    return F.when((mapping == "fixed_range") & ~(finite(near) & finite(far) & (far > near)),
                  F.lit("fixed range requires far > near"))


def validate_channels(seqs: DataFrame, channels: DataFrame, roles: list[str]) -> DataFrame:
    """(seq_id, role) pairs without a chosen channel, or whose choice the sequence does not have.

    seqs(seq_id, <role columns>), channels(seq_id, channel).
    """
    asked = seqs.select("seq_id", F.explode(F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(r).alias("channel")) for r in roles])).alias("a")).select("seq_id", "a.*")
    return asked.join(channels.select("seq_id", "channel").distinct(), ["seq_id", "channel"], "left_anti")


def auto_select_channel(channels: DataFrame, role: str, ordinal: str = "ordinal") -> DataFrame:
    """First channel of the best rule per sequence; ties keep listing order."""
    ranked = channels.withColumn("rank", channel_rule_rank(F.col("channel"), role)).where("rank IS NOT NULL")
    return ranked.groupBy("seq_id").agg(
        F.min_by("channel", F.struct("rank", ordinal)).alias("channel"), big(F.min("rank")).alias("rule"))


# The characters stripped around probe and log lines.
_BLANKS = " \t\r\n"


def strip_line(c: Column) -> Column:
    return F.ltrim(F.rtrim(c, F.lit(_BLANKS)), F.lit(" \t"))


def normalise_codec(c: Column) -> Column:
    """Lower-case codec token, null unless it is a plain token of at most 64 characters."""
    t = F.lower(strip_line(c))
    ok = t.rlike(r"^[a-z0-9_.\-]{1,64}$") & ~t.isin("n/a", "unknown")
    return F.when(ok, t)


def probe_to_clips(lines: DataFrame) -> DataFrame:
    """key=value probe lines (clip_id, line_no, line) to one typed row per clip; the last value wins.

    Clips without a resolution or a positive frame rate are left out, see ``probe_errors``.
    """
    out = _probe_fields(lines)
    return out.where("error IS NULL").drop("error")


def probe_errors(lines: DataFrame) -> DataFrame:
    return _probe_fields(lines).where("error IS NOT NULL").select("clip_id", "error")


def _probe_fields(lines: DataFrame) -> DataFrame:
    line = strip_line(F.col("line"))
    eq = F.instr(line, "=")
    kv = lines.select("clip_id", "line_no", F.when(eq > 0, F.substring(line, F.lit(1), eq - 1)).alias("key"),
                      F.when(eq > 0, F.substring(line, eq + 1, F.length(line))).alias("value")).where("key IS NOT NULL")

    def last(key: str, value: Column) -> Column:
        use = (F.col("key") == key) & value.isNotNull()
        return F.max_by(F.when(use, value), F.when(use, F.col("line_no")))

    value = F.col("value")
    known = F.when(value != "N/A", value)
    num, den = F.split(value, "/")[0].try_cast("double"), F.get(F.split(value, "/"), F.lit(1)).try_cast("double")
    fps = F.when(value.contains("/"), F.when(den == 0, 0.0).otherwise(num / den)).otherwise(num)
    whole = r"^\s*\+?([0-9]+)"
    as_int = F.regexp_extract(value, whole, 1).try_cast("bigint")
    agg = kv.groupBy("clip_id").agg(
        last("width", as_int).alias("width"), last("height", as_int).alias("height"),
        last("avg_frame_rate", F.coalesce(fps, F.lit(0.0))).alias("fps"),
        last("nb_frames", F.when(known.isNotNull(), as_int)).alias("nb_frames"),
        last("duration", known.try_cast("double")).alias("duration_s"),
        last("codec_name", normalise_codec(known)).alias("codec_name"),
        last("codec_tag_string", F.lower(strip_line(known))).alias("codec_tag"),
        last("profile", known).alias("profile"), last("pix_fmt", known).alias("pix_fmt"),
    )
    frames = F.when(F.coalesce(F.col("nb_frames"), F.lit(0)) > 0, F.col("nb_frames")).when(
        F.col("duration_s") > 0, big(F.round(F.col("duration_s") * F.col("fps"))))
    error = F.when(~((F.coalesce(F.col("width"), F.lit(0)) > 0) & (F.coalesce(F.col("height"), F.lit(0)) > 0)),
                   "no resolution").when(~(F.coalesce(F.col("fps"), F.lit(0.0)) > 0), "no frame rate")
    return agg.select(
        "clip_id", "width", "height", "fps", "duration_s", F.coalesce(frames, F.lit(0)).cast("bigint").alias("total_frames"),
        F.coalesce(F.col("codec_name"), F.when(F.col("codec_tag") == "av01", "av1")).alias("codec"),
        "profile", "pix_fmt", error.alias("error"))


def first_passing(attempts: DataFrame) -> DataFrame:
    """Per clip the passing candidate of lowest priority number and the trail of what was tried.

    attempts(clip_id, name, prio, passed). Candidates after the first success are never tried, so
    they are not in the trail; ``chosen`` is null when none passed.
    """
    a = attempts.withColumn("_stop", F.min(F.when(F.col("passed"), F.col("prio"))).over(W.partitionBy("clip_id")))
    tried = a.where("_stop IS NULL OR prio <= _stop")
    return tried.groupBy("clip_id").agg(
        F.min_by(F.when(F.col("passed"), F.col("name")), F.when(F.col("passed"), F.col("prio"))).alias("chosen"),
        F.count(F.lit(1)).alias("attempts"),
        # bounded: one entry per candidate name
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prio", "name", "passed"))),
                                 lambda s: F.concat(s["name"], F.when(s["passed"], ":ok").otherwise(":failed"))),
                     ",").alias("trail"))


def advertised(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Names that are the second whitespace token of a capability line."""
    token = F.get(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "), F.lit(1))
    return names.join(lines.select(token.alias("name")).where("name IS NOT NULL"), "name", "left_semi")


def compact_log(lines: DataFrame, key: str = "doc_id", max_lines: int = 12, max_chars: int = 2800) -> DataFrame:
    """First occurrence of each trimmed, non-empty line per log, up to the first one over budget."""
    t = lines.select(key, "line_no", strip_line(F.col("line")).alias("line")).where("line <> ''")
    # Deduplicate by aggregation (map-side combine) before any per-log ordering.
    first = t.groupBy(key, "line").agg(F.min("line_no").alias("line_no"))
    w = W.partitionBy(key).orderBy("line_no")
    # The line budget is a plain top-k, which Spark already limits before the shuffle, so a log of
    # any length reaches the running sum as at most max_lines rows.
    head = first.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= max_lines)
    run = head.withColumn("chars", F.sum(F.octet_length("line")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # The running size only grows, so the rows within budget are exactly those before the stop.
    return run.where(F.col("chars") <= max_chars).select(
        key, big("ordinal").alias("ordinal"), big("line_no").alias("line_no"), "line", big("chars").alias("chars"))


def asset_manifest(files: DataFrame, critical: DataFrame) -> DataFrame:
    """Totals over files(path, bytes, sha256) plus one row per critical path with a missing flag."""
    totals = files.agg(F.count(F.lit(1)).alias("file_count"), big(F.sum("bytes")).alias("total_bytes"))
    rows = critical.select("path").distinct().join(files.select("path", "bytes", "sha256"), "path", "left")
    # totals is a single row
    return rows.crossJoin(F.broadcast(totals)).select(
        "path", "bytes", "sha256", F.col("sha256").isNull().alias("missing"), "file_count", "total_bytes")


def hash_files(spark, root: str) -> DataFrame:
    """files(path, bytes, sha256) of a folder, hashed where the blocks are read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))
