"""URL filters by a path-template tree, in SQL only.

Hand-written rules decide the URLs they fit and serve as labels. For each host, path segments are generalised to their
shapes (numbers, numbers with an extension, long or hexadecimal keys). From the root down, a position with many rare values
below one parent becomes a wildcard; parents that are wildcards already share their children, so variable segments below
variable ones are found too. Then, from the deepest level up, branches below one parent that go on alike are merged:
branches with the same most common continuation form a family, and those whose continuations are distributed as the
family's (total variation of a quarter at most) become one wildcard unless their labels contradict those of the others
(two-proportion test at 5 %). A template is rejected when its smoothed labelled purity, (blocked + 1) / (labelled + 2),
reaches ``PURITY`` with at least ``LEAST_LABELS`` labels; all tests are on whole numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import read_table, settle

#: (verdict, host and all its subdomains, start of the path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
WILD_CHILDREN, WILD_SHARE = 16, 4
LEAST_PAGES, LEAST_LABELS = 10, 10
PURITY = 8  # tenths

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_case(rules: list[tuple[str, str, str]], pick: int) -> str:
    """A CASE over the rules, the longest first; ``pick`` 0 gives the rule's text, 1 its verdict."""
    lines = []
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = f"(host = {quote(host)} OR right(host, {len(host) + 1}) = {quote('.' + host)}) AND left(path, {len(path)}) = {quote(path)}"
        lines.append(f"WHEN {fits} THEN {quote((host + path, verdict)[pick])}")
    return f"CASE {' '.join(lines)} ELSE NULL END" if lines else "CAST(NULL AS string)"


SHAPE = """CASE WHEN regexp_like({s}, '^[0-9]+$') THEN '<n>' WHEN regexp_like({s}, '^[0-9]+[.][a-z0-9]+$') THEN concat('<n>', regexp_extract({s}, '[.][a-z0-9]+$', 0))
 WHEN length({s}) >= 8 AND regexp_like({s}, '^[0-9a-f]+$') THEN '<h>' WHEN length({s}) > 32 THEN '<s>' ELSE {s} END"""

CUT = """SELECT page_id, url, translate(raw, '{upper}', '{lower}') AS host, {extract}(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path
 FROM (SELECT *, {extract}(rest, '^[^/?#]*', 0) AS raw FROM (SELECT page_id, url, CASE WHEN {instr}(url, '://') > 0 THEN substr(url, {instr}(url, '://') + 3) ELSE '' END AS rest FROM {pages}) AS a) AS b"""

#: The positions of a level that become wildcards: ``steps`` has a row for each path that reaches the level.
WILD = """SELECT host, parent FROM steps GROUP BY host, parent HAVING count(DISTINCT child) >= {wild_children} AND sum(n) < {wild_share} * count(DISTINCT child)"""

#: The steps that merge the branches of a level, in order; each reads the ones before it, and first ``leaf(node, branch,
#: rest, n, labelled, blocked)``: paths by parent, segment and what follows. ``joined`` has the merged branches.
MERGE = {
    "leaves": """SELECT node, branch, rest, sum(n) AS n FROM leaf GROUP BY node, branch, rest""",
    "modes": """SELECT node, branch, rest AS mode FROM (SELECT *, row_number() OVER (PARTITION BY node, branch ORDER BY n DESC, rest) AS rn FROM leaves) AS t WHERE rn = 1""",
    "family": """SELECT l.node, m.mode, l.branch, l.rest, l.n FROM leaves l JOIN modes m ON l.node = m.node AND l.branch = m.branch""",
    "totals": """SELECT node, mode, sum(n) AS n FROM family GROUP BY node, mode""",
    "rests": """SELECT node, mode, rest, sum(n) AS n FROM family GROUP BY node, mode, rest""",
    "sizes": """SELECT node, mode, branch, sum(n) AS n FROM family GROUP BY node, mode, branch""",
    "labels": """SELECT node, branch, sum(labelled) AS labelled, sum(blocked) AS blocked FROM leaf GROUP BY node, branch""",
    "apart": """SELECT l.node, l.mode, l.branch, sum(abs(CAST(l.n AS {big}) * h.n - CAST(r.n AS {big}) * b.n)) AS near, sum(r.n) AS covered
 FROM family l JOIN rests r ON l.node = r.node AND l.mode = r.mode AND l.rest = r.rest JOIN sizes b ON l.node = b.node AND l.branch = b.branch JOIN totals h ON l.node = h.node AND l.mode = h.mode
 GROUP BY l.node, l.mode, l.branch""",
    "alike": """SELECT b.node, b.mode, b.branch, c.labelled, c.blocked FROM sizes b JOIN apart a ON b.node = a.node AND b.branch = a.branch JOIN totals h ON b.node = h.node AND b.mode = h.mode
 JOIN labels c ON b.node = c.node AND b.branch = c.branch
 WHERE b.n >= {least_pages} AND 2 * (a.near + CAST(b.n AS {big}) * (h.n - a.covered)) <= CAST(b.n AS {big}) * h.n""",
    "pool": """SELECT node, mode, count(*) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM alike GROUP BY node, mode""",
    "joined": """SELECT node, branch FROM (SELECT a.node, a.branch, p.n, CAST(a.labelled AS double) AS n1, CAST(a.blocked AS double) AS b1, CAST(p.labelled - a.labelled AS double) AS n2, CAST(p.blocked - a.blocked AS double) AS b2
 FROM alike a JOIN pool p ON a.node = p.node AND a.mode = p.mode) AS t
 WHERE n >= 2 AND (n1 = 0 OR n2 = 0 OR (b1 * n2 - b2 * n1) * (b1 * n2 - b2 * n1) * (n1 + n2) <= 3.84 * (b1 + b2) * (n1 + n2 - b1 - b2) * n1 * n2)""",
}
PURE = """SELECT host, template, CASE WHEN sum(labelled) >= {least_labels} AND 10 * (sum(blocked) + 1) >= {purity} * (sum(labelled) + 2) THEN 'block' ELSE 'allow' END AS method FROM template GROUP BY host, template"""
#: Steps that Spark writes down, so that no later step plans them again.
SETTLED = ("family", "alike")
NUMBERS = {"wild_children": WILD_CHILDREN, "wild_share": WILD_SHARE, "least_pages": LEAST_PAGES, "least_labels": LEAST_LABELS, "purity": PURITY}


def merged_branches(leaf: DataFrame) -> DataFrame:
    """``node, branch``: the branches of one level that become one."""
    known = {"leaf": leaf}
    for name, sql in MERGE.items():
        sql = sql.format(big="decimal(38,0)", **NUMBERS)
        own = {t: known[t] for t in re.findall(r"(?:FROM|JOIN) (\w+)", sql) if t in known}
        found = leaf.sparkSession.sql(re.sub(r"(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in own else m[0], sql), **own)
        known[name] = settle(found) if name in SETTLED else found
    return known["joined"]


def templates(kinds: DataFrame) -> DataFrame:
    """``host, shape, template, labelled, blocked`` of ``kinds(host, shape, n, labelled, blocked)``. One step down and one
    up for each level of the deepest path; each works on the different shapes that reach it."""
    spark = kinds.sparkSession
    tree = settle(kinds.withColumn("segs", F.split("shape", "/")).withColumn("up", F.array().cast("array<string>")))
    deepest = tree.agg(F.max(F.when(F.col("shape") != "", F.size("segs")))).first()[0] or 0
    for level in range(1, deepest + 1):  # ``up``: the generalised segments so far
        seg, parent = F.get("segs", F.lit(level - 1)), F.array_join("up", "/")
        reaches = (F.size("segs") >= level) & (F.col("shape") != "")
        steps = tree.where(reaches).select("host", parent.alias("parent"), seg.alias("child"), "n")
        wild = spark.sql(WILD.format(**NUMBERS).replace("FROM steps", "FROM {steps}"), steps=steps).withColumn("wild", F.lit(True))
        tree = tree.withColumn("parent", F.when(reaches, parent)).join(wild, ["host", "parent"], "left")
        tree = settle(tree.withColumn("up", F.when(reaches, F.concat("up", F.array(F.when(F.col("wild"), "*").otherwise(seg)))).otherwise(F.col("up"))).drop("parent", "wild"))
    tree = tree.withColumn("rest", F.lit(""))
    for level in range(deepest, 0, -1):  # ``rest``: the segments below, merged
        reaches = F.size("up") >= level
        node = F.when(reaches, F.concat_ws("/", F.concat("host", F.lit("/")), F.slice("up", 1, level - 1)))
        tree = tree.withColumns({"node": node, "branch": F.when(reaches, F.get("up", F.lit(level - 1)))})
        joined = merged_branches(tree.where(reaches).select("node", "branch", "rest", "n", "labelled", "blocked")).withColumn("one", F.lit(True))
        tree = tree.join(joined, ["node", "branch"], "left")
        tree = settle(tree.withColumn("rest", F.when(F.col("node").isNotNull(), F.concat(F.lit("/"), F.when(F.col("one"), "*").otherwise(F.col("branch")), "rest")).otherwise(F.col("rest"))).drop("node", "branch", "one"))
    return tree.select("host", "shape", F.when(F.col("rest") == "", "/").otherwise(F.col("rest")).alias("template"), "labelled", "blocked")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, template`` for each row of ``pages``.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and follows the template of the empty
    host. Repeated rows are judged one by one and count as often; a null page_id is carried through; an empty table
    gives an empty one; extra columns are not read. A rule fits its host and all subdomains if the path starts with
    the rule's; the longest wins. Rules are a short list, written into the plan.
    """
    spark = pages.sparkSession
    rules = RULES if rules is None else rules
    cut = CUT.format(upper=UPPER, lower=LOWER, extract="regexp_extract", instr="instr", pages="{pages}")
    shape = SHAPE.format(s="s")
    said = [rule_case(rules, k).replace("{", "{{").replace("}", "}}") for k in (0, 1)]
    judged = spark.sql(
        f"""SELECT page_id, host, path, {said[0]} AS rule, {said[1]} AS label,
         array_join(transform(filter(split(path, '/'), s -> s <> ''), s -> {shape}), '/') AS shape FROM ({cut}) AS c""",
        pages=pages.select("page_id", F.col("url").cast("string")),
    )
    kinds = settle(judged.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked")))
    template = templates(kinds)
    pure = spark.sql(PURE.format(**NUMBERS).replace("FROM template", "FROM {template}"), template=template)
    verdicts = settle(template.join(pure, ["host", "template"]).select("host", "shape", "template", "method"))
    return judged.join(verdicts, ["host", "shape"]).select("page_id", "host", "path", "rule", F.coalesce("label", "method").alias("verdict"), "template")


def oracle(levels: int = 3) -> str:
    """DuckDB SQL for paths of up to ``levels`` segments, one block of steps a level; the given tables have two."""
    cut = CUT.format(upper=UPPER, lower=LOWER, extract="regexp_extract", instr="instr", pages="pages")
    shape = SHAPE.format(s="s").replace("regexp_like", "regexp_matches")
    rules = [rule_case(RULES, k) for k in (0, 1)]
    steps = {}
    for k in range(1, levels + 1):
        steps[f"steps_{k}"] = f"SELECT host, array_to_string(up, '/') AS parent, segs[{k}] AS child, n FROM down_{k - 1} WHERE len(segs) >= {k}"
        steps[f"wild_{k}"] = WILD.format(**NUMBERS).replace("FROM steps", f"FROM steps_{k}")
        steps[f"down_{k}"] = f"""SELECT d.host, shape, n, labelled, blocked, segs, CASE WHEN len(segs) >= {k} THEN list_append(up, CASE WHEN w.host IS NULL THEN segs[{k}] ELSE '*' END) ELSE up END AS up
          FROM down_{k - 1} d LEFT JOIN wild_{k} w ON w.host = d.host AND w.parent = array_to_string(d.up, '/') AND len(segs) >= {k}"""
    steps[f"up_{levels + 1}"] = f"SELECT *, '' AS rest FROM down_{levels}"
    for k in range(levels, 0, -1):
        steps[f"leaf_{k}"] = f"SELECT array_to_string(list_prepend(host || '/', up[1:{k - 1}]), '/') AS node, up[{k}] AS branch, rest, n, labelled, blocked, host, shape FROM up_{k + 1} WHERE len(up) >= {k}"
        for name, sql in MERGE.items():
            steps[f"{name}_{k}"] = re.sub(rf"(FROM|JOIN) ({'|'.join(['leaf', *MERGE])})\b", rf"\1 \2_{k}", sql.format(big="hugeint", **NUMBERS))
        steps[f"up_{k}"] = f"""SELECT u.host, u.shape, u.n, u.labelled, u.blocked, u.up, CASE WHEN l.node IS NULL THEN u.rest ELSE concat('/', CASE WHEN j.node IS NULL THEN l.branch ELSE '*' END, u.rest) END AS rest
          FROM up_{k + 1} u LEFT JOIN leaf_{k} l ON l.host = u.host AND l.shape = u.shape LEFT JOIN joined_{k} j ON j.node = l.node AND j.branch = l.branch"""
    steps["template"] = "SELECT host, shape, CASE WHEN rest = '' THEN '/' ELSE rest END AS template, labelled, blocked FROM up_1"
    steps["pure"] = PURE.format(**NUMBERS)
    tree = ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in steps.items())
    return f"""WITH judged AS (SELECT page_id, host, path, {rules[0]} AS rule, {rules[1]} AS label,
     coalesce(array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {shape}), '/'), '') AS shape FROM ({cut}) AS c),
    down_0 AS MATERIALIZED (SELECT host, shape, count(*) AS n, count(label) AS labelled, count(CASE WHEN label = 'block' THEN 1 END) AS blocked, CASE WHEN shape = '' THEN [] ELSE string_split(shape, '/') END AS segs, CAST([] AS VARCHAR[]) AS up FROM judged GROUP BY host, shape),
    {tree}
    SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.label, p.method) AS verdict, t.template FROM judged j JOIN template t ON j.host = t.host AND j.shape = t.shape JOIN pure p ON p.host = t.host AND p.template = t.template"""


def op2_urls(spark, sf_dir: str) -> DataFrame:
    """``judge_urls`` with the contract's rules on the whole table ``pages``; see there for odd rows."""
    return judge_urls(read_table(spark, sf_dir, "pages"))
