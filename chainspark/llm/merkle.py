"""Merkle manifest of a dataset by time-forward processing over node labels.

Nodes are labelled (tree, level, index), children before parents. A node's digest is a message to its
parent, taken from a queue in label order. The queue's outer part is a table: the nodes of a
round, dealt by blocks of ``fan ** levels`` neighbours and sorted by label, which Spark does on
disk where memory ends. A block holds a bounded number of nodes and takes its own messages
from a heap; what leaves it, one digest, is a message of the next round. A second sweep in reverse
order hands every block the proof suffix of its top, and every node gets its siblings plus
that suffix; leaves come last. A hot source is many blocks, and no task holds more than some of them.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.llm.ranks import rank_within
from chainspark.session import cut_lineage

FAN = 16
#: Levels that a block folds at once: 16 ** 2 nodes a block.
LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<pos: int, others: binary>>"
_ARROW_STEPS = pa.list_(pa.struct([("pos", pa.int32()), ("others", pa.binary())]))
_NODES = "tree bigint, k bigint, n bigint, digest binary"


def leaf_digest(**changed: Column) -> Column:
    """sha256 (hex) of a row's fields, each ``-`` if null, else UTF-8 byte count, ``:`` and value."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _digest(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def _depth(n: int, fan: int, levels: int) -> int:
    """Levels that a block of a tree of n nodes folds: none above its only node."""
    depth = 0
    while n > 1 and depth < levels:
        n, depth = -(-n // fan), depth + 1
    return depth


def _block_levels(digests: list[bytes], depth: int, fan: int) -> list[list[bytes]]:
    """Digests of a block level by level: messages leave a heap in label order, runs become parents."""
    levels: list[list[bytes]] = [[] for _ in range(depth + 1)]
    queue = [(0, k, d) for k, d in enumerate(digests)]
    heapq.heapify(queue)
    while queue:
        level, k, d = heapq.heappop(queue)
        levels[level].append(d)
        if level == depth:
            continue
        run = [d]
        while queue and queue[0][0] == level and queue[0][1] // fan == k // fan:
            run.append(heapq.heappop(queue)[2])
        levels[level].extend(run[1:])
        heapq.heappush(queue, (level + 1, k // fan, _digest(run)))
    return levels


def _steps(levels: list[list[bytes]], k: int, fan: int) -> list[dict]:
    """Position in its run and digests of the others of the run, from node k of a block to its top."""
    out = []
    for nodes in levels[:-1]:
        run, pos = nodes[k // fan * fan:k // fan * fan + fan], k % fan
        out.append({"pos": pos, "others": b"".join(run[:pos] + run[pos + 1:])})
        k //= fan
    return out


def fold_proof(digest: bytes, steps: list[dict]) -> bytes:
    """The root that a digest and its proof lead to."""
    for step in steps:
        cut = 32 * step["pos"]
        digest = _digest([step["others"][:cut], digest, step["others"][cut:]])
    return digest


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("k")


def _labelled(rows: DataFrame) -> DataFrame:
    """Rows with tree (0-based number of their source, null first), k (0-based place in it) and n (its rows).

    Rows are dealt by range of (source, doc_id); counts per (source, slot) give each slot its start.
    """
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(rows.repartitionByRange(slots, "source", "doc_id", "leaf").withColumn("slot", F.spark_partition_id()))
    whole = Window.partitionBy("source")
    parts = (dealt.groupBy("source", "slot").agg(F.count("*").alias("c"))
             .withColumn("before", F.coalesce(F.sum("c").over(
                 whole.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("n", F.sum("c").over(whole)))
    numbers = rank_within(parts.select("source").distinct().withColumn("all", F.lit(0)), ["all"], ["source"], "tree")
    numbers = numbers.select(F.col("source").alias("s"), (F.col("tree") - 1).cast("bigint").alias("tree"))
    parts = (parts.join(numbers, F.col("source").eqNullSafe(F.col("s")))
             .select(F.col("source").alias("s"), F.col("slot").alias("o"), "before", "n", "tree"))
    inner = F.row_number().over(Window.partitionBy("source", "slot").orderBy("doc_id", "leaf"))
    return (dealt.withColumn("row", inner)
            .join(parts, (F.col("slot") == F.col("o")) & F.col("source").eqNullSafe(F.col("s")))
            .withColumn("k", (F.col("before") + F.col("row") - 1).cast("bigint"))
            .drop("row", "slot", "o", "s", "before"))


def _forward(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """Tables of the nodes (tree, k, n, digest) that open each round; the last has one node a tree."""
    size = fan ** levels
    kinds = pa.schema([("tree", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def fold(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        n = table["n"][0].as_py()
        top = _block_levels(table["digest"].to_pylist(), _depth(n, fan, levels), fan)[-1]
        return pa.table({"tree": table["tree"].slice(0, 1), "k": [table["k"][0].as_py() // size], "n": [-(-n // size)],
                         "digest": top}, schema=kinds)
    rounds = [nodes]
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        blocks = nodes.select("tree", "k", "n", "digest").groupBy("tree", F.floor(F.col("k") / size).alias("block"))
        nodes = cut_lineage(blocks.applyInArrow(fold, _NODES))
        rounds.append(nodes)
    return rounds


def _downward(rounds: list[DataFrame], tops: DataFrame, fan: int, levels: int) -> DataFrame:
    """Proof steps of the nodes that open round 1, from those (tree, k, subroot, steps) of the trees' tops.

    The block of a node of round r is node k of round r + 1, so that table is the queue of suffixes.
    """
    size = fan ** levels

    def sweep(key, nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, suffix = _sorted(nodes), above["steps"][0].as_py()
        inner = _block_levels(nodes["digest"].to_pylist(), _depth(nodes["n"][0].as_py(), fan, levels), fan)
        steps = [_steps(inner, k, fan) + suffix for k in range(nodes.num_rows)]
        return pa.table({"tree": nodes["tree"], "k": nodes["k"], "subroot": pa.array([above["subroot"][0].as_py()] * len(steps), pa.binary()),
                         "steps": pa.array(steps, _ARROW_STEPS)})
    for nodes in reversed(rounds[1:-1]):
        left = nodes.groupBy("tree", F.floor(F.col("k") / size).alias("block"))
        tops = cut_lineage(left.cogroup(tops.groupBy("tree", "k")).applyInArrow(
            sweep, f"tree bigint, k bigint, subroot binary, steps {_STEPS}"))
    return tops


def manifest(docs: DataFrame, check: Column | None = None, fan: int = FAN, levels: int = LEVELS,
             proofs: bool = False) -> DataFrame:
    """Leaf digest, root and proof of every row of documents (doc_id, source, lang, n_chars, text).

    Leaves of a source ascend by doc_id (null first; ties by digest). While more than one node remains,
    every ``fan`` neighbours become the sha256 of their hex digests; what remains is the subroot. The
    subroots, null source first, then by UTF-8 bytes, give the root likewise. ``check`` is a hex digest
    to be folded up the leaf's proof instead of the leaf itself; verified tells whether that gives the
    root. With ``proofs`` the steps (position in the run, digests of the others) are returned too.

    Null fields are leaves' fields like others; empty texts count 0 bytes; repeated rows are leaves of
    their own with equal digests; a lone row is leaf, subroot and root with an empty proof; an empty
    table gives an empty table; other columns are not read.
    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (and proof).
    """
    size = fan ** levels
    leaf = leaf_digest()
    asked = leaf if check is None else check
    kind = docs.schema["doc_id"].dataType.simpleString()
    leaves = cut_lineage(_labelled(docs.select("doc_id", "source", F.unhex(leaf).alias("leaf"), F.unhex(asked).alias("asked")))
                         .select("doc_id", "tree", "k", "n", F.col("leaf").alias("digest"), "asked"))
    lower = _forward(leaves, fan, levels)
    tops = lower[-1].select("tree", "digest")
    sources = tops.count()
    upper = _forward(tops.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("k"),
                                 F.lit(sources).cast("bigint").alias("n"), "digest"), fan, levels)
    found = upper[-1].first()
    root = found["digest"] if found else b""
    none = F.array().cast(_STEPS)
    # the sources are nodes of the upper tree: its sweep ends at them, one round below that of the leaves' blocks
    suffix = _downward([None, *upper], upper[-1].select("tree", "k", F.lit(None).cast("binary").alias("subroot"), none.alias("steps")), fan, levels)
    suffix = (suffix.drop("subroot", "tree").join(tops.withColumnRenamed("tree", "k"), "k")
              .select(F.col("k").alias("tree"), F.lit(0).cast("bigint").alias("k"), F.col("digest").alias("subroot"), "steps"))
    suffix = _downward(lower, suffix, fan, levels)

    def finish(key, nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, rest = _sorted(nodes), above["steps"][0].as_py()
        inner = _block_levels(nodes["digest"].to_pylist(), _depth(nodes["n"][0].as_py(), fan, levels), fan)
        tail = b"".join(s["others"] for s in rest).hex().encode()
        sub, shas, folded, steps = above["subroot"][0].as_py().hex(), [], [], []
        for k, asked in enumerate(nodes["asked"].to_pylist()):
            own = _steps(inner, k, fan)
            shas.append(hashlib.sha256(b"".join(s["others"] for s in own).hex().encode() + tail).hexdigest())
            folded.append(fold_proof(asked, own + rest).hex())
            if proofs:
                steps.append(own + rest)
        out = {"doc_id": nodes["doc_id"], "leaf": [d.hex() for d in nodes["digest"].to_pylist()], "subroot": [sub] * len(shas),
               "proof_sha256": shas, "folded_root": folded}
        if proofs:
            out["proof"] = pa.array(steps, _ARROW_STEPS)
        return pa.table(out)
    blocks = leaves.groupBy("tree", F.floor(F.col("k") / size).alias("block"))
    out = blocks.cogroup(suffix.groupBy("tree", "k")).applyInArrow(
        finish, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string" + (f", proof {_STEPS}" if proofs else ""))
    return out.select("doc_id", "leaf", "subroot", F.lit(root.hex()).alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == root.hex()).alias("verified"), *(["proof"] if proofs else []))


def _manifest_sql(depth: int = 8) -> str:
    """The manifest in SQL, for sources of up to 16 ** depth rows and as many sources."""
    def leaf(text):
        cells = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return "sha256(" + " || ".join(cells) + ")"
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
           "lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
           "lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)")
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"e AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS f FROM documents)",
             "p0 AS (SELECT *, leaf AS s, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM e)"]

    def tree(tag, first):
        steps.append(first)
        for j in range(depth):
            steps.append(f"{tag}r{j} AS (SELECT t, k // 16 AS k, list(h ORDER BY k) AS hs, max(n) AS n FROM "
                         f"(SELECT *, count(*) OVER (PARTITION BY t) AS n FROM {tag}{j}) GROUP BY t, k // 16)")
            steps.append(f"{tag}{j + 1} AS (SELECT t, k, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {tag}r{j})")

    def climb(tag, key, first, name):
        for j in range(depth):
            at = f"(p.k // {16 ** j})"
            before, after = f"array_to_string(r.hs[1:{at} % 16], '')", f"array_to_string(r.hs[{at} % 16 + 2:], '')"
            steps.append(f"{name}{j + 1} AS (SELECT p.* EXCLUDE (f, proof), CASE WHEN r.n = 1 THEN f ELSE sha256({before} || f || {after}) END AS f, "
                         f"CASE WHEN r.n = 1 THEN proof ELSE proof || {before} || {after} END AS proof "
                         f"FROM {first if j == 0 else name + str(j)} p JOIN {tag}r{j} r ON {key} IS NOT DISTINCT FROM r.t AND {at} // 16 = r.k)")
    tree("a", "a0 AS (SELECT source AS t, k, leaf AS h FROM p0)")
    tree("b", f"b0 AS (SELECT 0 AS t, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS k, h, t AS source FROM a{depth})")
    climb("a", "p.source", "p0", "p")
    steps.append(f"q0 AS (SELECT p.* EXCLUDE (k, s), b.k, b.h AS subroot FROM p{depth} p JOIN b0 b ON p.source IS NOT DISTINCT FROM b.source)")
    climb("b", "0", "q0", "q")
    return ("WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified "
            f"FROM q{depth} CROSS JOIN (SELECT h AS root FROM b{depth})")


MANIFEST_SQL = _manifest_sql()
