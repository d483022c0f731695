"""Trees and graphs: subtrees by doubling, citation counts, personalised PageRank."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAMPING, ROUNDS = 0.5, 30
#: About so many edges, up to four times as many, go to one task, and of one node so many at most.
LARGEST = 1_000_000
#: So many edges of a block are a row.
PIECE = 1 << 18
#: What is sent of a node: reached, or reached and with neighbours that it leads on to.
REACHED, LEADS_ON = 1, 2


def subtree_totals(spark: SparkSession, tree: DataFrame) -> DataFrame:
    """tree (node, parent, amount) to node, total, members: its own amount and all below it, trees of any depth.

    Ancestors are reached by doubling: each round joins what a node reaches with what that reaches, so a tree of depth d takes
    log2(d) rounds; each is checkpointed in the shared folder. A null amount counts nothing; a parent that isn't there is none.
    """
    nodes = tree.select("node", "parent", F.col("amount")).checkpoint()
    jump = nodes.filter("parent is not null").join(nodes.select(F.col("node").alias("parent")), "parent").select("node", F.col("parent").alias("up"))
    reach, done = nodes.select("node", F.col("node").alias("up")), False
    while not done:  # reach holds ancestors up to 2^k - 1 steps above, jump leads 2^k steps up
        reach = reach.unionByName(reach.select("node", F.col("up").alias("m")).join(jump.select(F.col("node").alias("m"), "up"), "m").select("node", "up")).checkpoint()
        jump = jump.select("node", F.col("up").alias("m")).join(jump.select(F.col("node").alias("m"), "up"), "m").select("node", "up").checkpoint()
        done = jump.isEmpty()
    return reach.join(nodes.select("node", "amount"), "node").groupBy(F.col("up").alias("node")).agg(F.sum("amount").alias("total"), F.count("*").alias("members"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, every: int = 5, most: int = LARGEST) -> DataFrame:
    """Personalised PageRank of undirected weighted edges (a, b, weight) from seeds (node, weight): node, mass.

    The restart vector is normalised; mass at a node without neighbours is dropped, as is mass that a null end gets. A null weight
    moves nothing. The edges are shuffled once, into blocks of most edges, four times as many where blocks are many, by their end of more distinct nodes (a node of more than most
    by its other ends), and kept as arrays of places among their block's nodes. Each node has a home, which sums its mass and sends it
    to the blocks that hold the node; a block sends back one sum for each of its nodes. So a round shuffles a number for each node of a
    block, either way, as one row for a block and a home; both have bucketed tables, dropped at the end. Nodes once reached stay
    reached; as soon as a round reaches no more, nodes and edges out of reach are left out. What is sent is checkpointed in the shared
    folder, each round up to then and every few rounds after.
    """
    spark, made = edges.sparkSession, []
    kind = edges.schema["a"].dataType

    def saved(df: DataFrame, by: str | None = None) -> DataFrame:
        made.append(f"pagerank_{uuid.uuid4().hex}")
        writer = df.write.bucketBy(n, by) if by else df.write
        writer.saveAsTable(made[-1])
        return spark.table(made[-1])

    def drop(names: list[str]) -> None:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    try:
        links = saved(edges.filter("a is not null or b is not null").select("a", "b", F.col("weight").cast("double").alias("weight")))
        total = seeds.agg(F.sum("weight")).first()[0] or 1.0  # without seeds there is no mass to spread
        start = seeds.groupBy(F.col("node").cast(kind).alias("node")).agg((F.sum("weight") / F.lit(float(total))).alias("restart")).checkpoint()
        held, few, many = links.agg(F.count("*"), F.approx_count_distinct("a"), F.approx_count_distinct("b")).first()
        if few > many:
            links = links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")
        # Blocks of about most edges; beyond two for a core they grow, up to four times that, as each round has a task for each.
        rows = held + start.count()
        n = min(-(-rows // most), max(2 * spark.sparkContext.defaultParallelism, -(-rows // (4 * most)))) or 1
        # A number for each bucket, that falls into it: blocks and homes are named by these, so that each has a bucket of its own.
        named = spark.range(64 * n + 64).select(F.col("id").cast("int").alias("name")).groupBy(F.expr(f"pmod(hash(name), {n})").alias("bucket")).agg(F.min("name").alias("name"))
        names = F.array(*[F.lit(r["name"]) for r in sorted(named.collect())])

        def dealt(column) -> Column:
            return F.element_at(names, F.pmod(F.hash(column), F.lit(n)) + 1)

        # Hubs are sought only among nodes of a hash that has more than most edges.
        links = links.withColumn("bin", F.expr(f"pmod(hash(b), {16 * n})"))
        full = links.groupBy("bin").count().filter(F.col("count") > most).select("bin")
        hubs = links.join(F.broadcast(full), "bin").groupBy("b").count().filter(F.col("count") > most).select(F.col("b").alias("hub"), F.lit(True).alias("wide")).checkpoint()
        links = links.join(F.broadcast(hubs), F.col("b").eqNullSafe(F.col("hub")), "left")
        links = links.select(F.when(F.col("wide"), dealt("a")).otherwise(dealt("b")).alias("p"), "a", "b", dealt("a").alias("home_a"), dealt("b").alias("home_b"), "weight")
        shape = f"p int, h int, src binary, dst binary, weight binary, nodes array<{kind.simpleString()}>, degree binary"
        blocks = saved(links.repartition(n, "p").mapInArrow(_blocks, shape), "p")
        drop(made[:1])
        links = blocks.filter("src is not null").select("p", "src", "dst", "weight")
        members = blocks.filter("src is null").select("p", "h", "nodes", "degree", F.lit(None).cast("double").alias("restart"))
        members = members.unionByName(start.select(F.lit(None).cast("int").alias("p"), dealt("node").alias("h"), F.array("node").alias("nodes"), F.lit(None).cast("binary").alias("degree"), "restart"))
        at_home = f"h int, p int, place binary, nodes array<{kind.simpleString()}>, size long, total binary, restart binary, seed binary"
        homes = saved(members.repartition(n, "h").groupBy("h").applyInArrow(_home, at_home), "h")
        size = homes.agg(F.sum("size")).first()[0] or 0

        def reach(sent: DataFrame) -> int:
            return sent.filter("p is null").agg(F.sum("reached")).first()[0] or 0

        told = "h int, p int, mass binary, seen binary, reached long"
        walk = lambda home, got: _summed(home, got, damping)
        plain = homes.drop("nodes")
        if not rounds:
            return start.select("node", F.col("restart").alias("mass"))
        sent, closed = plain.groupBy("h").applyInArrow(lambda home: _summed(home, None, damping), told).checkpoint(), False
        reached = reach(sent)
        for i in range(rounds):
            got = links.groupBy("p").cogroup(sent.filter("p is not null").groupBy("p")).applyInArrow(_moved, "h int, p int, mass binary, seen binary")
            if i + 1 == rounds:
                last = homes.groupBy("h").cogroup(got.groupBy("h")).applyInArrow(lambda home, got: _masses(home, got, damping), f"node {kind.simpleString()}, mass double")
                return last.checkpoint()
            sent = plain.groupBy("h").cogroup(got.groupBy("h")).applyInArrow(walk, told)
            if not closed or (i + 1) % every == 0:
                sent = sent.checkpoint()
            if not closed:
                before, reached = reached, reach(sent)
                closed = reached == before
                if closed:
                    if reached < size:
                        old, seen = list(made), sent.filter("p is not null").select("h", "p", "seen")
                        links = saved(links.groupBy("p").cogroup(seen.groupBy("p")).applyInArrow(_kept_links, "p int, src binary, dst binary, weight binary"), "p")
                        homes = saved(homes.groupBy("h").cogroup(seen.groupBy("h")).applyInArrow(_kept_nodes, at_home), "h")
                        drop(old)
                        plain = homes.drop("nodes")
                    sent = sent.mapInArrow(_kept_masses, told)
    finally:
        drop(made)


def _bytes(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The arrays in a column's cells, one behind the other."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def _lengths(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64) // np.dtype(dtype).itemsize


def _cells(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.cumsum(lengths)
    return pa.array([values[e - k : e].tobytes() for e, k in zip(ends.tolist(), lengths.tolist())], pa.binary())


def _told_apart(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the distinct ones, and these; a null is one of them, the last."""
    coded = values.dictionary_encode()
    names = coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else pa.array([], values.type)
    at = np.concatenate([np.zeros(0, np.int32), *(c.indices.fill_null(len(names)).to_numpy(zero_copy_only=False) for c in coded.chunks)])
    return at, pa.concat_arrays([names, pa.nulls(1, names.type)]) if values.null_count else names


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def _rows(names: str, **columns) -> pa.RecordBatch:
    """A batch of columns in that order; those not given are null."""
    n = len(next(iter(columns.values())))
    kinds = {"p": pa.int32(), "h": pa.int32(), "size": pa.int64(), "reached": pa.int64()}
    made = [columns.get(c) for c in names.split()]
    return pa.RecordBatch.from_arrays([pa.nulls(n, kinds.get(c, pa.binary())) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kinds[c]) for c, x in zip(names.split(), made)], names.split())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's blocks; it has one, unless it was dealt out anew. They are not sorted by block before, as edges are many."""
    if got := [b for b in batches if b.num_rows]:
        t = pa.Table.from_batches(got)
        blocks = pc.unique(t["p"])
        for p in blocks:
            yield from _block(t if len(blocks) == 1 else t.filter(pc.equal(t["p"], p))).to_batches()


def _block(t: pa.Table) -> pa.Table:
    """The edges of a block to rows of PIECE edges each, and a row for each home of its nodes: they are in the order of the homes."""
    p, m, kind, columns, rows = t["p"][0].as_py(), len(t), t.schema.field("a").type, "p h src dst weight nodes degree", []
    at, nodes = _told_apart(pa.chunked_array(t["a"].chunks + t["b"].chunks, kind))
    home = np.empty(len(nodes), np.int32)
    home[at] = np.concatenate([t["home_a"].to_numpy(), t["home_b"].to_numpy()])
    order = np.argsort(home, kind="stable")
    place = np.empty(len(nodes), np.int32)
    place[order] = np.arange(len(nodes), dtype=np.int32)
    src, dst, weight = place[at[:m]], place[at[m:]], t["weight"].fill_null(0.0).to_numpy()
    for i in range(0, m, PIECE):
        e = slice(i, i + PIECE)
        rows.append(_rows(columns, p=[p], src=pa.array([src[e].tobytes()]), dst=pa.array([dst[e].tobytes()]), weight=pa.array([weight[e].tobytes()]), nodes=pa.nulls(1, pa.list_(kind))))
    degree = np.bincount(src, weight, len(nodes)) + np.bincount(dst, weight, len(nodes))
    homes, lengths = np.unique(home, return_counts=True)
    rows.append(_rows(columns, p=np.full(len(homes), p), h=homes, nodes=_lists(nodes.take(pa.array(order)), lengths), degree=_cells(degree, lengths)))
    return pa.Table.from_batches(rows)


def _home(t: pa.Table) -> pa.Table:
    """What blocks and seeds (without a block) name of a home's nodes to one row of these, and a row for each block with their places."""
    kind, columns = t.schema.field("nodes").type, "h p place nodes size total restart seed"
    at, nodes = _told_apart(pa.chunked_array([c.flatten() for c in t["nodes"].chunks], kind.value_type))
    lengths = pc.list_value_length(t["nodes"]).to_numpy().astype(np.int64)
    seeds = pc.is_null(t["p"]).to_numpy()
    of_seed, h = np.repeat(seeds, lengths), t["h"][0].as_py()
    restart = np.bincount(at[of_seed], t["restart"].fill_null(0.0).to_numpy()[seeds], len(nodes))
    total = np.bincount(at[~of_seed], _bytes(t["degree"], np.float64), len(nodes))
    total[pc.is_null(nodes).to_numpy(zero_copy_only=False)] = 0  # no neighbours, as nothing leads on from it
    seed = np.zeros(len(nodes), np.uint8)
    seed[at[of_seed]] = 1
    own = _rows(columns, h=[h], nodes=_lists(nodes, np.array([len(nodes)])), size=[len(nodes)], total=pa.array([total.tobytes()]), restart=pa.array([restart.tobytes()]), seed=pa.array([seed.tobytes()]))
    blocks = t["p"].drop_null().to_numpy()
    return pa.Table.from_batches([own, _rows(columns, h=np.full(len(blocks), h), p=blocks, place=_cells(at[~of_seed].astype(np.int32), lengths[~seeds]), nodes=pa.nulls(len(blocks), kind))])


def _moved(links: pa.Table, sent: pa.Table) -> pa.Table:
    """What moves along a block's edges, summed by node, for each home."""
    sent = sent.sort_by("h")
    mass, leads, lengths = _bytes(sent["mass"], np.float64), _bytes(sent["seen"], np.uint8) == LEADS_ON, _lengths(sent["mass"], np.float64)
    src, dst, weight = _bytes(links["src"], np.int32), _bytes(links["dst"], np.int32), _bytes(links["weight"], np.float64)
    got = np.bincount(dst, weight * mass[src], len(mass)) + np.bincount(src, weight * mass[dst], len(mass)) if len(src) else np.zeros(len(mass))
    met = None
    if len(leads):
        met = np.zeros(len(mass), bool)
        met[dst[leads[src]]] = True
        met[src[leads[dst]]] = True
        met = _cells(met, lengths)
    return pa.Table.from_batches([_rows("h p mass seen", h=sent["h"].to_numpy(), p=sent["p"].to_numpy(), mass=_cells(got, lengths), seen=met)])


def _at_home(home: pa.Table, got: pa.Table | None, damping: float):
    """A home's row, its rows for blocks, mass and whether it is reached by node; all are, where blocks don't say."""
    own, blocks = home.filter(pc.is_null(home["p"])), home.filter(pc.is_valid(home["p"])).sort_by("p")
    place, restart = _bytes(blocks["place"], np.int32), _bytes(own["restart"], np.float64)
    seen = _bytes(own["seed"], bool).copy()
    if got is None:
        return own, blocks, place, restart, seen
    got = got.sort_by("p")
    mass = np.bincount(place, _bytes(got["mass"], np.float64), len(restart)) + (1 - damping) * restart
    if len(got) and not got["seen"].null_count:
        seen[place[_bytes(got["seen"], bool)]] = True
    else:  # nodes of no block are seeds
        seen[:] = True
    return own, blocks, place, mass, seen


def _summed(home: pa.Table, got: pa.Table | None, damping: float) -> pa.Table:
    """A home's nodes' mass, for a unit of weight, for each block that holds some; and a row without a block that counts those reached."""
    own, blocks, place, mass, seen = _at_home(home, got, damping)
    total, lengths = _bytes(own["total"], np.float64), _lengths(blocks["place"], np.int32)
    passes = total != 0
    each = np.divide(damping * mass, total, out=np.zeros(len(mass)), where=passes)
    columns, h = "h p mass seen reached", home["h"][0].as_py()
    still = got is not None and got["seen"].null_count
    tells = None if still else _cells((seen * np.where(passes, LEADS_ON, REACHED)).astype(np.uint8)[place], lengths)
    rows = _rows(columns, h=np.full(len(blocks), h), p=blocks["p"].to_numpy(), mass=_cells(each[place], lengths), seen=tells)
    return pa.Table.from_batches([rows, _rows(columns, h=[h], reached=[int(seen.sum())])])


def _masses(home: pa.Table, got: pa.Table, damping: float) -> pa.Table:
    own, _, _, mass, seen = _at_home(home, got, damping)
    nodes = own["nodes"].combine_chunks().flatten() if len(own) else pa.array([], home.schema.field("nodes").type.value_type)
    return pa.table({"node": nodes.filter(pa.array(seen)), "mass": mass[seen]})


def _kept_links(links: pa.Table, sent: pa.Table) -> pa.Table:
    """A block's edges between nodes that are reached, by their places among these."""
    seen = _bytes(sent.sort_by("h")["seen"], np.uint8) > 0
    src, dst, weight = _bytes(links["src"], np.int32), _bytes(links["dst"], np.int32), _bytes(links["weight"], np.float64)
    keep, place = seen[src] & seen[dst], (np.cumsum(seen) - 1).astype(np.int32)
    src, dst, weight, rows = place[src[keep]], place[dst[keep]], weight[keep], []
    for i in range(0, max(len(src), 1), PIECE):
        e = slice(i, i + PIECE)
        rows.append(_rows("p src dst weight", p=links["p"][:1].to_numpy(), src=pa.array([src[e].tobytes()]), dst=pa.array([dst[e].tobytes()]), weight=pa.array([weight[e].tobytes()])))
    return pa.Table.from_batches(rows)


def _kept_nodes(home: pa.Table, sent: pa.Table) -> pa.Table:
    """A home's nodes that are reached, and their places among these for each block that holds some."""
    own, blocks, place, total, seen = _at_home(home, None, 0)
    total, restart, seed, h = _bytes(own["total"], np.float64), _bytes(own["restart"], np.float64), _bytes(own["seed"], np.uint8), home["h"][0].as_py()
    kind, columns, of_block = own.schema.field("nodes").type, "h p place nodes size total restart seed", _bytes(sent.sort_by("p")["seen"], np.uint8) > 0
    seen[place[of_block]] = True
    nodes, new, cells = own["nodes"].combine_chunks().flatten().filter(pa.array(seen)), (np.cumsum(seen) - 1).astype(np.int32), np.repeat(np.arange(len(blocks)), _lengths(blocks["place"], np.int32))
    left = np.bincount(cells[of_block], minlength=len(blocks))
    own = _rows(columns, h=[h], nodes=_lists(nodes, np.array([len(nodes)])), size=[len(nodes)], total=pa.array([total[seen].tobytes()]), restart=pa.array([restart[seen].tobytes()]), seed=pa.array([seed[seen].tobytes()]))
    p = blocks["p"].to_numpy()[left > 0]
    return pa.Table.from_batches([own, _rows(columns, h=np.full(len(p), h), p=p, place=_cells(new[place[of_block]], left[left > 0]), nodes=pa.nulls(len(p), kind))])


def _kept_masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is sent, without nodes that are not reached and without the word that others are."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t.filter(pc.is_valid(t["p"]))
        seen, lengths = _bytes(t["seen"], np.uint8) > 0, _lengths(t["seen"], np.uint8)
        left = np.bincount(np.repeat(np.arange(len(t)), lengths)[seen], minlength=len(t))
        some = left > 0
        yield _rows("h p mass seen reached", h=t["h"].to_numpy()[some], p=t["p"].to_numpy()[some], mass=_cells(_bytes(t["mass"], np.float64)[seen], left[some]))


def citation_counts(cites: DataFrame) -> DataFrame:
    """cites (citing, cited) to work, cites, cited_by: distinct works on either side."""
    out = cites.groupBy(F.col("citing").alias("work")).agg(F.countDistinct("cited").alias("cites"))
    into = cites.groupBy(F.col("cited").alias("work")).agg(F.countDistinct("citing").alias("cited_by"))
    return out.join(into, "work", "full").select("work", F.coalesce("cites", F.lit(0)).alias("cites"), F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


def rounds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The round in which each work is first reached: node, round, parent.

    edges (a, b) are walked both ways; seeds (node, round) are there from their round on (none: 1), without a parent, unless they are
    reached earlier. A work's round is one more than the least of its neighbours', and its parent the least neighbour of that
    round. Each step joins the last round's works alone with the edges, leaves out what has been reached, and is written to the
    shared folder; a hub's edges are counted together before they are shuffled. Works that nothing leads to are not given; null
    ends and seeds count for nothing, repeated edges once.
    """
    spark = edges.sparkSession
    both = edges.filter("a is not null and b is not null and a != b").select("a", "b")
    both = both.union(both.select("b", "a")).distinct().checkpoint()
    start = seeds.filter("node is not null").groupBy("node").agg(F.min(F.coalesce("round", F.lit(1))).cast("int").alias("round")).checkpoint()
    starts = sorted(r[0] for r in start.select("round").distinct().collect())  # as many as there are different rounds of seeds
    at, done, frontier = (starts or [0])[0], None, None
    while starts or frontier is not None:
        new = start.filter(F.col("round") == at).select("node", "round", F.lit(None).cast(both.schema["b"].dataType).alias("parent"))
        if frontier is not None:
            met = both.join(frontier.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
            # Reached from the last round: a seed of this round is one of those, and keeps its parent.
            new = met.select("node", F.lit(at).alias("round"), "parent").unionByName(new.join(met, "node", "left_anti"))
        if done is not None:
            new = new.join(done.select("node"), "node", "left_anti")
        new = new.checkpoint()
        starts = [s for s in starts if s > at]
        if new.isEmpty():
            frontier = None
            at = starts[0] if starts else at
            continue
        done = new if done is None else done.unionByName(new).checkpoint()
        frontier, at = new, at + 1
    return done if done is not None else spark.createDataFrame([], f"node {both.schema['a'].dataType.simpleString()}, round int, parent {both.schema['a'].dataType.simpleString()}")
