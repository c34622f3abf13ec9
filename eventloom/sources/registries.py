"""Text registries, build logs and stored feeds as rows."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import log_issue, platform
from ..operators.runs import automaton, carried


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of small text files, in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def feed_registry(text: DataFrame) -> DataFrame:
    """(file, url, name): a comment line names the feed URL that follows it."""
    names = F.regexp_extract("line", r"^#\s*(.+?)\s*$", 1)
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = text.withColumn("name", F.last(F.nullif(names, F.lit("")), ignorenulls=True).over(order))
    return rows.filter(F.trim("line").rlike(r"^https?://")).select("file", F.trim("line").alias("url"), "name")


def area_registry(text: DataFrame) -> DataFrame:
    """(file, name, excluded): one lower-cased place a line, ``!`` or ``-`` in front excludes it."""
    rows = text.withColumn("line", F.trim(F.regexp_replace("line", r"#.*$", ""))).filter("line <> ''")
    return rows.select("file", F.lower(F.regexp_replace("line", r"^[!-]\s*", "")).alias("name"), F.col("line").rlike(r"^[!-]").alias("excluded"))


def keyword_registry(text: DataFrame) -> DataFrame:
    rows = text.withColumn("word", F.trim(F.regexp_replace("line", r"#.*$", ""))).filter("word <> ''")
    return rows.select("file", "word")


def load_aggregators(path: str) -> list[str]:
    """Aggregator names of a configuration file, in the driver: a list of fixed, small size."""
    with open(path, encoding="utf-8") as f:
        return list(json.load(f)["aggregators"])


def download_list(feeds: DataFrame, city: str, statuses: tuple[str, ...] = ("active", "pending"), kinds: tuple[str, ...] = ("ics_url",)) -> DataFrame:
    return feeds.filter((F.col("city") == city) & F.col("status").isin(*statuses) & F.col("feed_type").isin(*kinds)).orderBy("name", "url")


def prodids(files: DataFrame) -> DataFrame:
    """(file, prodid, platform) from the first 52 lines of each calendar."""
    head = F.array_join(F.slice(F.split("content", r"\r?\n"), 1, 52), "\n")
    found = F.trim(F.regexp_extract(head, r"(?m)^PRODID:(.*)$", 1))
    return files.select("file", found.alias("prodid")).filter("prodid <> ''").withColumn("platform", platform(F.col("prodid")))


#: Lines of a log, as they are matched; fixed values.
RUN_LINE = r"^\[([^\]]+)\]\[([^\]]+)\]\s+RUN\s+(.+)$"
EXIT_LINE = r"^\[([^\]]+)\]\[([^\]]+)\]\s+EXIT\s+(-?\d+)\s+(.+)$"
LOGGED = r"(?:^|[\s\]])([A-Za-z0-9_]+) - (ERROR|WARNING) - (.*)$"
TRACEBACK = "Traceback (most recent call last)"
ERROR_LINE = r"(?i)error: the following arguments are required|HTTP Error \d+|ConnectionError|Timeout|: error:|(?<!Timeout)Error:"
SCRIPT = r"(\w[\w-]*)\.py"
TRACED_SCRIPT = r'File ".*?/(\w[\w-]*)\.py"'

#: Outside a block, on the line after its head, further down; by (2 * closing + head).
_BLOCK_STEPS = [[0, 1, 0, 1], [2, 2, 2, 2], [2, 2, 0, 0]]


def build_issues(log: DataFrame) -> DataFrame:
    """(file, line_no, city, phase, command, source, level, kind, message) of a build log with
    (file, line_no, line), all without nulls.

    ``[city][phase] RUN label`` opens a command and ``EXIT code label`` closes it.  Issues are
    logged lines of level ERROR or WARNING, lines with a known sign of an error, tracebacks, and
    failed exits.  A traceback is one issue, at its head: it goes on to the first line that is
    neither blank nor indented, the line after the head aside, and its message is that line (the
    head, if the log ends before).  Other lines of a traceback are no issues and no markers, but
    for failed exits.  ``command`` is the label of the last marker; ``source`` the label that is
    open, else the logger's name, the last script in the traceback, or the script named in the
    line or the one above.

    No task takes a whole file: see ``operators.runs``."""
    line = F.col("line")
    get = lambda p, i: F.nullif(F.regexp_extract(line, p, i), F.lit(""))
    rows = log.select("file", "line_no", F.regexp_replace("line", r"\s+$", "").alias("line"))
    marker, logged = line.rlike(RUN_LINE) | line.rlike(EXIT_LINE), line.rlike(LOGGED)
    head = F.contains(line, F.lit(TRACEBACK)) & ~marker & ~logged
    closing = (line != "") & ~F.startswith(line, F.lit(" "))
    rows = rows.withColumn("symbol", closing.cast("int") * 2 + head.cast("int"))
    rows = automaton(rows, "file", "line_no", "symbol", _BLOCK_STEPS)

    outside, is_head = F.col("state") == 0, F.col("symbol") % 2 == 1
    opened = F.struct(
        F.coalesce(get(RUN_LINE, 1), get(EXIT_LINE, 1)).alias("city"), F.coalesce(get(RUN_LINE, 2), get(EXIT_LINE, 2)).alias("phase"),
        F.trim(F.coalesce(get(RUN_LINE, 3), get(EXIT_LINE, 4))).alias("command"), line.rlike(RUN_LINE).alias("open"),
    )
    rows = carried(rows, ["file"], "line_no", {
        "last": (F.when(outside & marker, opened), True),
        "block": (F.when(outside & is_head, F.col("line_no")), True),
        "above": (F.struct(get(SCRIPT, 1).alias("script")), False),
    })

    # the closing line is met in state 2 and leaves it
    closes = (F.col("state") == 2) & (F.col("symbol") >= 2)
    traced = get(TRACED_SCRIPT, 1)
    inside = rows.where(~outside | is_head)
    blocks = inside.groupBy("file", "block").agg(
        F.max_by(traced, F.when(traced.isNotNull(), F.col("line_no"))).alias("traced"), F.max(F.when(closes, line)).alias("final")
    )
    blocks = blocks.select("file", F.col("block").alias("line_no"), "traced", "final", F.lit(True).alias("found"))

    failed = F.coalesce(get(EXIT_LINE, 3).cast("bigint") != 0, F.lit(False))
    seen = outside & ~marker
    one = F.trim(line)
    level = F.when(failed, "error").when(seen & logged, F.lower(get(LOGGED, 2))).when(seen & (is_head | line.rlike(ERROR_LINE)), "error")
    rows = rows.withColumn("level", level).where("level is not null").join(blocks, ["file", "line_no"], "left")
    label = F.when(F.col("last.open"), F.col("last.command"))
    block, said = F.col("found").isNotNull(), F.regexp_extract(line, LOGGED, 3)
    source = F.when(block, F.col("traced")).when(failed, get(EXIT_LINE, 4)).when(logged, F.regexp_replace(get(LOGGED, 1), "Scraper$", ""))
    message = F.when(block, F.coalesce("final", "line")).when(logged & ~failed, said).otherwise(one)
    kind = F.when(block, "traceback").otherwise(log_issue(F.col("message"), F.col("level")))
    place = lambda i, name: F.coalesce(get(r"^\[([^\]]+)\]\[([^\]]+)\]", i), F.col(f"last.{name}")).alias(name)
    return rows.withColumn("message", message).select(
        "file", "line_no", place(1, "city"), place(2, "phase"),
        F.coalesce(F.when(failed, get(EXIT_LINE, 4)), F.col("last.command")).alias("command"),
        F.coalesce(label, source, F.when(~block & ~logged, F.coalesce(get(SCRIPT, 1), F.col("above.script")))).alias("source"),
        "level", kind.alias("kind"), "message",
    )


def distinct_issues(issues: DataFrame) -> DataFrame:
    return issues.dropDuplicates(["message", "command", "level"])


_OPS = {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def rest_filter(df: DataFrame, params: dict[str, str], related: dict[str, tuple[DataFrame, str, str]] | None = None) -> DataFrame:
    """A table read by REST-style parameters: ``col=op.value`` with eq, neq, gt, gte, lt,
    lte, like, ilike, in, is and not before each; ``or=(col.op.value,...)``; and ``select``,
    ``order``, ``limit``, ``offset``.  A term ``name(columns)`` of ``select`` embeds the related
    row as a struct, null if there is none; ``related`` gives its table, the column that
    refers to it, and its key."""
    out = df
    for name, text in params.items():
        if name == "or":
            terms = [t.split(".", 2) for t in _terms(text.strip()[1:-1])]
            out = out.filter(reduce(or_, (_condition(F.col(c), op, value) for c, op, value in terms)))
        elif name not in ("select", "order", "limit", "offset"):
            op, _, value = text.partition(".")
            out = out.filter(_condition(F.col(name), op, value))
    terms = _terms(params.get("select", "*"))
    for term in (t for t in terms if t.endswith(")")):
        name, _, columns = term[:-1].partition("(")
        table, refers, key = (related or {})[name]
        chosen = F.struct(*[F.col(c) for c in (table.columns if columns == "*" else columns.split(","))])
        out = out.join(table.select(F.col(key).alias(f"__{name}"), chosen.alias(name)), F.col(refers) == F.col(f"__{name}"), "left").drop(f"__{name}")
    if "order" in params:
        keys = []
        for term in params["order"].split(","):
            name, *how = term.split(".")
            c = F.col(name).desc() if "desc" in how else F.col(name).asc()
            if "nullslast" in how:
                c = F.col(name).desc_nulls_last() if "desc" in how else F.col(name).asc_nulls_last()
            keys.append(c)
        out = out.orderBy(*keys)
    if "offset" in params:
        out = out.offset(int(params["offset"]))
    if "limit" in params:
        out = out.limit(int(params["limit"]))
    return out.select(*[t.partition("(")[0] for t in terms])


def _terms(text: str) -> list[str]:
    """Split at commas outside brackets."""
    return re.findall(r"(?:[^,(]|\([^)]*\))+", text)


def _condition(c: Column, op: str, value: str) -> Column:
    if op in _OPS:
        v = F.lit(value)
        return {"eq": c == v, "neq": c != v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
    if op == "in":
        return c.isin(*[x.strip().strip('"') for x in value.strip("()").split(",")])
    if op == "is":
        return c.isNull() if value == "null" else c == F.lit(value == "true")
    if op in ("like", "ilike"):
        pattern = "".join(".*" if x == "*" else re.escape(x) for x in re.split(r"([*])", value))
        return c.rlike(f"{'(?is)' if op == 'ilike' else '(?s)'}^{pattern}$")
    if op == "not":
        return ~_condition(c, *value.split(".", 1))
    raise ValueError(f"unknown operator {op}")
