"""Merkle manifest of a table: a radix-ranked trie over each source's rows, and one over the sources.

Every row is a leaf. A leaf's exact place within its source comes from hierarchical histograms of the digits of its id
(``ranks``), not from a sort of the source. The place's digits to the base of the fan-out are its key in the
trie: nodes that share all but the last digit are a run and become one node, their longest common prefix. Blocks of ``FANOUT ** DEPTH``
places, which share a prefix, are reduced by one call in a task, so a level of blocks is one shuffle
of what is left; then the siblings' digests come down the same blocks, each block's path from above being one row beside its nodes.

H is SHA-256 in lower-case hexadecimal of its inputs put together, digests as their text. Edge cases: rows with one id go by their leaves, and
equal rows are leaves each; a null id comes first, and is never tampered with; a null source is one, the first; an empty table has no rows and no root;
texts are hashed whole; other columns, however called, are no part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grouped, save
from .prefix_trie import CRC
from .ranks import exact_places, hex_keys, long_keys, sent_if_few, text_keys

FANOUT, DEPTH = 3, 6
BLOCK = FANOUT**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "grp string, place long, node string"


def digest(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_of(values: list[Column]) -> Column:
    """H of the fields: '-' for a null, else the bytes of its text, ':', the text."""
    told = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def _levels(nodes: list[str], last: bool) -> list[list[str]]:
    """A block's nodes level by level: until one is left in the last block of a trie, else exactly ``DEPTH`` levels up."""
    out = [nodes]
    while len(out[-1]) > 1 if last else len(out) <= DEPTH:
        low = out[-1]
        out.append([digest(*low[k : k + FANOUT]) for k in range(0, len(low), FANOUT)])
    return out


def _siblings(levels: list[list[str]], i: int) -> str:
    """The path from a block's node to its top: a step a level, as 'left,right;'."""
    out = []
    for row in levels[:-1]:
        a = i - i % FANOUT
        out.append(f"{''.join(row[a:i])},{''.join(row[i + 1 : a + FANOUT])};")
        i //= FANOUT
    return "".join(out)


def proof_of(path: str) -> str:
    """H of the siblings of all steps."""
    return digest(path.replace(",", "").replace(";", ""))


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its siblings give."""
    for step in path.split(";")[:-1]:
        left, right = step.split(",")
        leaf = digest(left, leaf, right)
    return leaf


def _up(t: pa.Table) -> Iterator[pa.RecordBatch]:
    order = np.argsort(t.column("place").to_numpy(), kind="stable")
    top = _levels(t.column("node").take(pa.array(order)).to_pylist(), t.column("n")[0].as_py() <= BLOCK)[-1][0]
    yield pa.RecordBatch.from_pydict({"grp": [t.column("grp")[0].as_py()], "place": pa.array([t.column("block")[0].as_py()], pa.int64()), "node": [top]})


def _down(t: pa.Table) -> Iterator[pa.RecordBatch]:
    own = t.filter(pc.is_valid(t.column("node"))).sort_by("place")
    last = own.column("n")[0].as_py() <= BLOCK
    above = next(x for x in t.column("path").to_pylist() if x is not None)
    levels = _levels(own.column("node").to_pylist(), last)
    paths = [_siblings(levels, i) + above for i in range(own.num_rows)]
    yield from own.select(["grp", "place"]).append_column("path", pa.array(paths, pa.string())).to_batches()


def tries(nodes: DataFrame) -> list[DataFrame]:
    """Written tables of the tops of blocks, level by level, with ``n``, the nodes that their group has; the first is ``nodes``, the last has a root a group."""
    n = save(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    out = [save(nodes.join(sent_if_few(n), "grp"), "nodes")]
    most = n.agg(F.max("n")).first()[0] or 0
    while most > 1:
        n = n.withColumn("n", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}"))
        tops = grouped(_blocks(out[-1].select("grp", "place", "node", "n")), ["grp", "block"], _up, NODE)
        out.append(save(tops.join(sent_if_few(n), "grp"), "nodes"))
        most = -(-most // BLOCK)
    return out


def paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, place, path) of the first level's nodes; ``tops`` (grp, path): the path of each group's root."""
    at = tops.select("grp", F.lit(0).cast("long").alias("place"), "path")
    for nodes in reversed(levels[:-1]):
        at = save(grouped(_with_path(nodes.select("grp", "place", "node", "n"), at), ["grp", "block"], _down, "grp string, place long, path string"), "paths")
    return at


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {BLOCK}"))


def _with_path(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes by block, and the path of each block's top as one more row of it."""
    return _blocks(nodes).unionByName(above.withColumnRenamed("place", "block"), allowMissingColumns=True)


def manifest(docs: DataFrame, altered=None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per row: the id, leaf, subroot, root, proof_sha256, folded_root, verified. The first field is the id, a long, the second the source, the last the text.

    ``altered(id, text)`` is the text that is held against the manifest in a row's place, null for the row's own; without it rows verify themselves.
    """
    given = [docs[f"`{c}`"] for c in fields]
    ident, source, text = given[0], given[1], given[-1]
    new = altered(ident, text) if altered else F.lit(None).cast("string")
    bent = F.when(new.isNotNull(), leaf_of([*given[:-1], new]))
    rows = docs.select(ident.alias("id"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("grp"), leaf_of(given).alias("node"), bent.alias("bent"), F.monotonically_increasing_id().alias("row"))
    rows = save(rows, "leaves")
    own = tries(exact_places(rows, "grp", [*long_keys(F.col("id")), *hex_keys(F.col("node"), 64), F.col("row")], [F.col("id").asc_nulls_first(), F.col("node"), F.col("row")]))
    # the sources' own trie, in the order of their names' bytes; a null's mark stands before that of a name
    subs = save(own[-1].select("grp", F.col("node").alias("subroot")), "subroots")
    longest = subs.agg(F.max(F.octet_length("grp"))).first()[0] or 0
    placed = exact_places(subs.withColumn("all", F.lit("")), "all", text_keys(F.col("grp"), longest), [F.col("grp")])
    high = tries(placed.select(F.col("all").alias("grp"), "place", F.col("subroot").alias("node"), F.col("grp").alias("src")))
    top = high[-1].select("node").first()  # one row, or none
    root = F.lit(top["node"] if top else None).cast("string")
    down = paths(high, high[-1].select("grp", F.lit("").alias("path"))).select("place", "path")
    tops = save(high[0].select("place", F.col("src").alias("grp"), F.col("node").alias("subroot")).join(down, "place").drop("place"), "tops")
    above = paths(own[1:] or own, tops.select("grp", "path"))
    above = above.join(sent_if_few(tops.select("grp", "subroot")), "grp")

    def verify(t: pa.Table) -> Iterator[pa.RecordBatch]:
        own = t.filter(pc.is_valid(t.column("node"))).sort_by("place")
        head = t.filter(pc.is_valid(t.column("path")))
        path, sub = head.column("path")[0].as_py(), head.column("subroot")[0].as_py()
        leaves = own.column("node").to_pylist()
        levels = _levels(leaves, own.column("n")[0].as_py() <= BLOCK)
        proofs, folded = [], []
        for i, (leaf, new) in enumerate(zip(leaves, own.column("bent").to_pylist(), strict=True)):
            steps = _siblings(levels, i) + path
            proofs.append(proof_of(steps))
            folded.append(fold(new or leaf, steps))
        yield from pa.table({"id": own.column("id"), "leaf": own.column("node"), "subroot": [sub] * len(leaves), "proof_sha256": proofs, "folded_root": folded}).to_batches()

    both = _with_path(own[0].select("id", "grp", "place", "node", "bent", "n"), above)
    out = grouped(both, ["grp", "block"], verify, "id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select(F.col("id").alias(fields[0]), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def without_breaks(ident: Column, text: Column) -> Column:
    """The contract's tampering: texts of every second id, by checksum, lose their line ends."""
    return F.when((F.crc32(ident.cast("string").cast("binary")) % 2 == 0) & text.contains("\n"), F.replace(text, F.lit("\n"), F.lit("")))


def query(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), without_breaks)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS) + ")"
#: Tries as recursive queries, a level a round; siblings of a level are the rest of the run that a leaf's place is in.
SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, {_LEAF} AS leaf, {_LEAF.replace("text", "(CASE WHEN " + CRC.format("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS bent FROM documents),
l AS (SELECT *, coalesce('s' || source, 'n') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
v(grp, lvl, pos, h, n) AS (SELECT grp, 0, pos, leaf, n FROM l UNION ALL SELECT grp, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM v WHERE n > 1 GROUP BY grp, lvl, pos // 3, n),
r AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM v WHERE n = 1),
w(lvl, pos, h, n) AS (SELECT 1000, pos, subroot, n FROM r UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM w WHERE n > 1 GROUP BY lvl, pos // 3, n),
x AS (SELECT rid, l.grp, k.lvl, l.pos // (3 ** k.lvl)::BIGINT AS i FROM l JOIN (SELECT DISTINCT grp, lvl FROM v WHERE n > 1) k USING (grp)
    UNION ALL SELECT rid, NULL, k.lvl, r.pos // (3 ** (k.lvl - 1000))::BIGINT FROM l JOIN r USING (grp), (SELECT DISTINCT lvl FROM w WHERE n > 1) k),
y AS (SELECT grp, lvl, pos, h FROM v UNION ALL SELECT NULL, lvl, pos, h FROM w),
q AS (SELECT rid, x.lvl, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < i), '') AS a, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > i), '') AS b
    FROM x JOIN y ON x.grp IS NOT DISTINCT FROM y.grp AND x.lvl = y.lvl AND x.i // 3 = y.pos // 3 GROUP BY rid, x.lvl),
p AS (SELECT rid, string_agg(a || b, '' ORDER BY lvl) AS proof, list(a || ',' || b ORDER BY lvl) AS steps FROM q GROUP BY rid),
f AS (SELECT doc_id, leaf, subroot, (SELECT h FROM w WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(bent, coalesce(steps, [])), lambda z, s: sha256(split_part(s, ',', 1) || z || split_part(s, ',', 2))) AS folded_root FROM l JOIN r USING (grp) LEFT JOIN p USING (rid))
SELECT *, folded_root = root AS verified FROM f"""
