"""The isolation forest in SQL, for the oracle queries: draws, splits and scores level by level.

All names end in ``end``, so that one query can hold several forests.
"""

from __future__ import annotations

from collections.abc import Sequence

#: Splits of a tree at most: ceil(log2(256)).
LEVELS = 8


def uniform(*parts: str) -> str:
    """52 bits of the md5 of the parts joined by a bar, as a fraction."""
    text = " || '|' || ".join(parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0)"


def _expected(n: str) -> str:
    return f"(CASE WHEN {n} = 2 THEN 1.0 WHEN {n} > 2 THEN 2.0 * (ln({n} - 1.0) + 0.5772156649) - 2.0 * ({n} - 1.0) / {n} ELSE 0.0 END)"


def forest_ctes(
    source: str, features: Sequence[str], *, keys: Sequence[str] = ("plant", "unit", "tag"), identity: Sequence[str] = ("epoch_us(time)",), trees: int = 100, samples: int = 256,
    seed: int = 42, min_rows: int = 10, fit: str = "true", share: str | float = 0.1, among: str = "true", end: str = "",
) -> str:
    """CTEs up to ``judged{end}``: the rows of ``source`` in groups of enough rows, with score and is_outlier."""
    by = ", ".join(keys)
    who = [f"CAST({c} AS VARCHAR)" for c in (*keys, *identity)]
    same = lambda a, b, more=(): " AND ".join(f"{a}.{c} = {b}.{c}" for c in (*keys, *more))
    values = ", ".join(f"CAST({f} AS DOUBLE) AS f{i}" for i, f in enumerate(features))
    names = [f"f{i}" for i in range(len(features))]
    listed = ", ".join(names)
    round_ = "CAST(CAST(tree AS BIGINT) // at_once AS VARCHAR)"
    parts = [
        f"fa{end} AS (SELECT *, {values}, count(*) FILTER ({fit}) OVER (PARTITION BY {by}) AS fn, row_number() OVER () AS rid FROM {source})",
        f"fb{end} AS (SELECT *, least(1.0, {samples}.0 / fn) AS p, CAST(greatest(1, least({trees}, floor(1.0 / least(1.0, {samples}.0 / fn)))) AS BIGINT) AS at_once FROM fa{end} WHERE fn >= {min_rows})",
        f"d0{end} AS (SELECT {by}, rid, tree, 1 AS node, {listed} FROM fb{end}, (SELECT unnest(range(0, {trees})) AS tree) WHERE ({fit}) AND floor({uniform(f"'{seed}'", round_, *who)} / p) = CAST(tree AS BIGINT) % at_once)",
        f"fl{end} AS (SELECT {by}, avg(c) AS n_fit, count(*) AS n_trees, CAST(ceil(log2(greatest(2, least({samples}, max(c))))) AS BIGINT) AS lim FROM (SELECT {by}, tree, count(*) AS c FROM d0{end} GROUP BY {by}, tree) GROUP BY {by})",
        f"p0{end} AS (SELECT {by}, rid, tree, 1 AS node, {listed} FROM fb{end}, (SELECT unnest(range(0, {trees})) AS tree))",
    ]
    depths = []
    for level in range(LEVELS + 1):
        called = ("'" + str(seed) + "'", "CAST(tree AS VARCHAR)", "CAST(node AS VARCHAR)")
        ends_ = ", ".join(f"min({f}) AS lo{i}, max({f}) AS hi{i}" for i, f in enumerate(names))
        usable = " OR ".join(f"hi{i} > lo{i}" for i in range(len(names)))
        if len(names) == 1:
            chosen, cut = "0", f"hi0 - {uniform(*called, chr(39) + 't' + chr(39))} * (hi0 - lo0)"
        else:
            each = [f"CASE WHEN hi{i} > lo{i} THEN {uniform(*called, chr(39) + str(i) + chr(39))} ELSE -1 END" for i in range(len(names))]
            chosen = f"list_position([{', '.join(each)}], greatest({', '.join(each)})) - 1"
            pick = lambda c: "CASE chosen " + " ".join(f"WHEN {i} THEN {c}{i}" for i in range(len(names))) + " END"
            cut = f"{pick('hi')} - {uniform(*called, chr(39) + 't' + chr(39))} * ({pick('hi')} - {pick('lo')})"
        parts.append(
            f"s{level}{end} AS (SELECT *, {cut} AS threshold FROM (SELECT n.*, c > 1 AND ({usable}) AND {level} < lim AS split, {chosen} AS chosen, {level} + {_expected('c')} AS depth FROM "
            f"(SELECT {by}, tree, node, count(*) AS c, {ends_} FROM d{level}{end} GROUP BY {by}, tree, node) n JOIN fl{end} l USING ({by})))"
        )
        value = "f0" if len(names) == 1 else "CASE chosen " + " ".join(f"WHEN {i} THEN f{i}" for i in range(len(names))) + " END"
        depths.append(f"SELECT p.rid, s.depth FROM p{level}{end} p JOIN s{level}{end} s ON {same('p', 's', ('tree', 'node'))} WHERE NOT s.split")
        if level < LEVELS:
            for kind in ("d", "p"):
                columns = ", ".join(f"x.{c}" for c in (*keys, "rid", "tree"))
                parts.append(
                    f"{kind}{level + 1}{end} AS (SELECT {columns}, 2 * x.node + CASE WHEN {value} >= threshold THEN 1 ELSE 0 END AS node, {', '.join('x.' + n for n in names)} FROM {kind}{level}{end} x "
                    f"JOIN s{level}{end} s ON {same('x', 's', ('tree', 'node'))} WHERE s.split)"
                )
    parts += [
        f"ft{end} AS (SELECT rid, sum(depth) AS total FROM ({' UNION ALL '.join(depths)}) GROUP BY rid)",
        f"scored{end} AS (SELECT b.*, round(power(2.0, -(total / n_trees) / greatest({_expected('n_fit')}, 1e-12)), 4) AS score FROM fb{end} b JOIN fl{end} USING ({by}) JOIN ft{end} USING (rid))",
        f"ranked{end} AS (SELECT *, CAST('0x' || substr(md5({' || chr(124) || '.join(who)}), 1, 13) AS BIGINT) AS tie FROM scored{end})",
        *cut_ctes(by, f"ranked{end}", share, among, end),
    ]
    return ", ".join(parts)


def cut_ctes(by: str, ranked: str, share: str | float, among: str, end: str) -> list[str]:
    """CTEs up to ``judged{end}``: the rows of ``ranked`` with is_outlier, cut at a share of those among."""
    order = f"PARTITION BY {by} ORDER BY score DESC, tie % 4096, tie"
    beyond = "score > cut_score OR (score = cut_score AND (tie % 4096 < cut_bucket OR (tie % 4096 = cut_bucket AND tie <= cut_tie)))"
    return [
        f"placed{end} AS (SELECT *, row_number() OVER ({order}) AS place, ceil(({share}) * count(*) OVER (PARTITION BY {by}) - 1e-9) AS wanted FROM {ranked} WHERE {among})",
        f"cut{end} AS (SELECT {by}, score AS cut_score, tie % 4096 AS cut_bucket, tie AS cut_tie FROM placed{end} WHERE place = wanted)",
        f"judged{end} AS (SELECT r.*, coalesce({beyond}, false) AS is_outlier FROM {ranked} r LEFT JOIN cut{end} USING ({by}))",
    ]
