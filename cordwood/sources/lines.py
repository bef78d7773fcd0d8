"""Lines of the configured log files."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.functions.once import with_once

JSON = "json"
PLAIN = "plain"


@dataclass(frozen=True)
class LogSource:
    """One configured file (or glob of rolled files) of a service."""

    service: str
    path: str
    format: str = PLAIN

    def __post_init__(self) -> None:
        if self.format not in (JSON, PLAIN):
            raise ValueError(f"unknown log format {self.format!r}")


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//)?"
_WILD = re.compile(r"[*?\[\]{}]")


def _path_pattern(path: str) -> str:
    """Pattern of a file name without its scheme for a path with ``* ? [] {}``."""
    pattern, depth = "", 0
    for part in re.findall(r"\[[^\]]*\]|.", re.sub(_SCHEME, "", path)):
        depth += (part == "{") - (part == "}")
        if part == "*":
            pattern += "[^/]*"
        elif part == "?":
            pattern += "[^/]"
        elif part in ("{", "}") or (part == "," and depth):
            pattern += {"{": "(?:", "}": ")", ",": "|"}[part]
        elif len(part) > 1:
            pattern += part
        else:
            pattern += re.escape(part)
    return rf"^{pattern}\z"


def _one_glob(paths: list[str]) -> str:
    """A stream takes one path: the common root with the rest as alternatives."""
    if len(paths) == 1:
        return paths[0]
    common = os.path.commonprefix(paths)
    root = common[: common.rfind("/") + 1]
    if not root or root.endswith("://"):
        raise ValueError("the sources of a stream must lie under one root")
    return root + "{" + ",".join(path[len(root) :] for path in paths) + "}"


def _folder_and_name(path: str) -> tuple[str, str]:
    folder, _, name = re.sub(_SCHEME, "", path).rpartition("/")
    return folder, name


def _candidates(spark: SparkSession, sources: list[LogSource]) -> DataFrame | None:
    """(_folder, _candidates): by folder, the sources whose folder is named without wildcards.

    A name with at most one ``*`` is tested by its beginning and end, without a pattern.
    """
    by_folder: dict[str, list[tuple]] = {}
    for number, source in enumerate(sources):
        folder, name = _folder_and_name(source.path)
        if not _WILD.search(folder):
            begin, star, end = name.partition("*")
            plain = not _WILD.search(begin + end)
            pattern = None if plain else _path_pattern(name)
            least = len(begin) + len(end)
            most = None if star else least
            by_folder.setdefault(folder, []).append(
                (number, source.service, source.path, source.format, begin, end, least, most, pattern)
            )
    if not by_folder:
        return None
    kind = "struct<number:int,service:string,file:string,format:string,begin:string,end:string,least:int,most:int,pattern:string>"
    return spark.createDataFrame(list(by_folder.items()), f"_folder string, _candidates array<{kind}>")


def _anywhere(file: Column, sources: list[LogSource]) -> Column | None:
    """The first source with wildcards in its folder that a file matches, by a pattern for each."""
    chosen = None
    for number, source in enumerate(sources):
        if _WILD.search(_folder_and_name(source.path)[0]):
            found = _shown(F.lit(number), F.lit(source.service), F.lit(source.path), F.lit(source.format))
            test = file.rlike(_path_pattern(source.path))
            chosen = F.when(test, found) if chosen is None else chosen.when(test, found)
    return chosen


def _shown(number: Column, service: Column, file: Column, format: Column) -> Column:
    return F.struct(number.alias("number"), service.alias("service"), file.alias("file"), format.alias("format"))


def with_source(spark: SparkSession, lines: DataFrame, sources: list[LogSource]) -> DataFrame:
    """Adds ``_source``, the first source whose path the ``_file`` of a line matches.

    Sources are looked up by the folder of the file: the table of folders is as large as the
    configuration and is broadcast. Only sources with wildcards in their folders are tried
    one by one.
    """
    name = F.substring_index("_file", "/", -1)
    lines = lines.withColumn("_name", name)
    lines = lines.withColumn("_folder", F.expr("left(_file, greatest(length(_file) - length(_name) - 1, 0))"))
    candidates = _candidates(spark, sources)
    options = []
    if candidates is not None:
        lines = lines.join(F.broadcast(candidates), "_folder", "left")

        def fits(c: Column) -> Column:
            size = F.length("_name")
            ends = F.startswith(F.col("_name"), c["begin"]) & F.endswith(F.col("_name"), c["end"])
            sized = (size >= c["least"]) & (size <= F.coalesce(c["most"], size))
            return F.when(c["pattern"].isNull(), ends & sized).otherwise(_matches(c))

        with_patterns = any(_needs_pattern(s) for s in sources)

        def _matches(c: Column) -> Column:
            return F.col("_name").rlike(c["pattern"]) if with_patterns else F.lit(False)

        fitting = F.filter("_candidates", fits)
        options.append(F.get(F.transform(fitting, lambda c: _shown(c["number"], c["service"], c["file"], c["format"])), F.lit(0)))
    anywhere = _anywhere(F.col("_file"), sources)
    if anywhere is not None:
        options.append(anywhere)
    # The number comes first, so the least is the first source; nulls are passed over.
    first = F.least(*options) if len(options) > 1 else options[0]
    return with_once(lines, "_source", first)


def _needs_pattern(source: LogSource) -> bool:
    folder, name = _folder_and_name(source.path)
    return not _WILD.search(folder) and bool(_WILD.search(name.replace("*", "", 1)))


def read_lines(
    spark: SparkSession,
    sources: list[LogSource],
    streaming: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """``value, service, file, format`` for every line of the sources.

    Only the line feed ends a line, so a carriage return stays for the parser
    to strip. One scan covers all sources; the service is looked up by the
    folder and name of the file. The files must be rolled (immutable): Spark reads each file once.
    """
    if not sources:
        raise ValueError("no log sources configured")
    paths = [source.path for source in sources]
    if streaming:
        reader = spark.readStream.option("lineSep", "\n")
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        lines = reader.text(_one_glob(paths))
    else:
        lines = spark.read.option("lineSep", "\n").text(paths)
    file = F.coalesce(F.try_url_decode(F.col("_metadata.file_path")), F.col("_metadata.file_path"))
    located = lines.select("value", F.regexp_replace(file, _SCHEME, "").alias("_file"))
    located = with_source(spark, located, sources)
    return located.select("value", "_source.service", "_source.file", "_source.format")
