"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned so that their leading dimensions carry most of the
length. Tiles are ranges of the first dimension: two vectors further apart there than the threshold
allows cannot link, so only neighbouring tiles meet. Within a pair of tiles the products of the leading
dimensions are summed first; what the other dimensions can add is at most the product of the
suffix norms, and a pair is dropped as soon as that cannot reach the threshold. Pairs that stay are
decided on the given components in double precision.

Equal vectors are one class with a weight. Tasks return sums of weights and a spanning forest of
their links, never the pairs. The rotation is fitted on at most ``FIT_VECTORS`` vectors; it affects
the speed only, as any rotation gives the same products.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
components of their own; shorter vectors count as padded with zeros. Null ids are greater than all
others; ids that repeat count as one vector where they are the least of their class. Other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.components import connected_components, dense_roots
from loomwork.llm.groups import grouped
from loomwork.session import materialize

THRESHOLD = 0.9
TILE_ROWS = 4096
#: The rotation is fitted on so many vectors, and so many bytes, at most.
FIT_VECTORS, FIT_BYTES = 10_000, 32 << 20
#: Rounding that a bound in single precision may be off by.
SLACK = 1e-4
STRIP = 512


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """List column as rows of length one in double precision, padded to ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    out /= np.abs(out).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def fit_rotation(rows: np.ndarray) -> np.ndarray:
    """Orthogonal columns in the order of the length that the rows have along them."""
    _, axes = np.linalg.eigh(rows.T @ rows)
    return np.ascontiguousarray(axes[:, ::-1])


def tile_links(a: np.ndarray, b: np.ndarray, turned_a: np.ndarray, turned_b: np.ndarray, threshold: float) -> np.ndarray:
    """Flags of the pairs of rows whose cosine reaches the threshold."""
    width = a.shape[1]
    cuts = sorted({max(1, width // 4), max(1, width // 2), width})
    turned_a, turned_b = turned_a.astype(np.float32), turned_b.astype(np.float32)

    def suffix(x: np.ndarray) -> list[np.ndarray]:
        return [np.sqrt(np.maximum(0, (x[:, c:].astype(np.float64) ** 2).sum(1))).astype(np.float32) for c in cuts]

    rest_a, rest_b = suffix(turned_a), suffix(turned_b)
    out = np.zeros((len(a), len(b)), np.bool_)
    least = np.float32(threshold - SLACK)
    for s in range(0, len(a), STRIP):
        strip = slice(s, s + STRIP)
        total = turned_a[strip, : cuts[0]] @ turned_b[:, : cuts[0]].T
        may = total + rest_a[0][strip, None] * rest_b[0][None, :] >= least
        i, j = np.nonzero(may)
        if len(i) > may.size // 16:  # copies of each other: whole products are cheaper than picked ones
            out[strip] = a[strip] @ b.T >= threshold
            continue
        near, i = total[i, j], i + s
        for k in range(1, len(cuts)):
            dims = slice(cuts[k - 1], cuts[k])
            near = near + np.einsum("ij,ij->i", turned_a[i, dims], turned_b[j, dims])
            keep = near + rest_a[k][i] * rest_b[k][j] >= least
            i, j, near = i[keep], j[keep], near[keep]
        exact = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
        out[i[exact], j[exact]] = True
    return out


def _tiles(cuts: np.ndarray, axes: np.ndarray, width: int, reach: float):
    """Map step: each vector, once for each pair of tiles that its tile belongs to."""
    tiles = len(cuts) + 1
    low = np.concatenate([[-np.inf], cuts])
    furthest = np.searchsorted(low, np.concatenate([cuts, [np.inf]]) + reach, "right") - 1  # last tile in reach of each
    nearest = np.searchsorted(furthest, np.arange(tiles), "left")

    def step(batches):
        for batch in batches:
            for c in range(0, batch.num_rows, 4096):
                part = batch.slice(c, 4096)
                unit = unit_rows(part.column(part.schema.get_field_index("vector")), width)
                first = unit @ axes[:, 0]
                a, b = np.searchsorted(cuts, first, "left"), np.searchsorted(cuts, first, "right")
                vertex = part.column(part.schema.get_field_index("vertex")).to_numpy()
                tile = a + vertex % (b - a + 1)  # values that fill several tiles are dealt among them
                low_reach, high_reach = np.minimum(nearest[a], tile), np.maximum(furthest[b], tile)
                copies = high_reach - low_reach + 1
                for k in range(int(copies.max(initial=0))):
                    pick = np.flatnonzero(copies > k)
                    other = low_reach[pick] + k
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.minimum(tile[pick], other)), pa.array(np.maximum(tile[pick], other)), pa.array(tile[pick]),
                            pa.array(vertex[pick]), part.column(part.schema.get_field_index("weight")).take(pa.array(pick)),
                            part.column(part.schema.get_field_index("vector")).take(pa.array(pick)),
                        ],
                        names=["ti", "tj", "tile", "vertex", "weight", "vector"],
                    )

    return step


def _compare(axes: np.ndarray, width: int, threshold: float):
    """Reduce step: (u, v) of a spanning forest, and (u, null, weight linked) for each vector with links."""

    def step(batches):
        for table in grouped(batches, ["ti", "tj"]):
            table = table.combine_chunks()
            tile, vertex = table.column("tile").to_numpy(), table.column("vertex").to_numpy()
            weight = table.column("weight").to_numpy()
            unit = unit_rows(table.column("vector").chunk(0), width)
            left = tile == table.column("ti")[0].as_py()
            same = table.column("ti")[0].as_py() == table.column("tj")[0].as_py()
            right = left if same else ~left
            a, b = unit[left], unit[right]
            linked = tile_links(a, b, a @ axes, b @ axes, threshold)
            if same:
                np.fill_diagonal(linked, False)
            i, j = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            if not len(i):
                continue
            linked = linked[np.ix_(i, j)]
            ids_a, ids_b = vertex[left][i], vertex[right][j]
            u, n = [ids_a], [linked @ weight[right][j]]
            if same:
                ids, square = ids_a, linked
            else:
                u.append(ids_b)
                n.append(linked.T @ weight[left][i])
                ids = np.concatenate([ids_a, ids_b])
                square = np.zeros((len(ids), len(ids)), np.bool_)
                square[: len(i), len(i) :] = linked
                square[len(i) :, : len(i)] = linked.T
            root = dense_roots(square)
            child = np.flatnonzero(root != np.arange(len(root)))
            u, n = np.concatenate(u), np.concatenate(n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([u, ids[child]])),
                    pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(ids[root[child]])]),
                    pa.array(np.concatenate([n, np.zeros(len(child), np.int64)])),
                ],
                names=["u", "v", "n"],
            )

    return step


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of ``vectors``."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = rows.where("usable").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = materialize(classes.withColumn("vertex", F.coalesce("rep", -1 - F.pmod(F.xxhash64("vector"), F.lit(1 << 62)))), "vector-classes")
    count, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    width = width or 1
    wanted = max(2, min(FIT_VECTORS, FIT_BYTES // (8 * width)))
    spread = max(1, int(count / wanted * 1000))
    sample = classes.where(F.pmod(F.xxhash64("vertex"), F.lit(spread)) < 1000).select("vector").limit(2 * wanted).toArrow()
    fitted = unit_rows(sample.combine_chunks().column("vector").chunk(0), width) if sample.num_rows else np.eye(width)
    axes = fit_rotation(fitted)
    tiles = max(1, -(-count // tile_rows))
    cuts = np.quantile(fitted @ axes[:, 0], np.arange(1, tiles) / tiles) if tiles > 1 else np.empty(0)
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    dealt = classes.select("vertex", "weight", "vector").mapInArrow(
        _tiles(cuts, axes, width, reach),
        f"ti long, tj long, tile long, vertex long, weight long, vector {dict(classes.dtypes)['vector']}",
    )
    found = dealt.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(_compare(axes, width, threshold), "u long, v long, n long")
    found = materialize(found, "vector-links")
    component = connected_components(found.where("v is not null").select("u", "v"))
    links = found.where("v is null").groupBy(F.col("u").alias("vertex")).agg(F.sum("n").alias("n"))
    whole = classes.join(component, "vertex", "left").join(links, "vertex", "left").withColumn("root", F.coalesce("component", "vertex"))
    # Written, so that the join sees two plain shuffles and a component of most classes can be split.
    whole = materialize(whole, "roots")
    least = materialize(whole.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    whole = whole.join(least, "root").select(
        F.col("vector").alias("class_vector"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    component_id = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.join(whole, F.col("usable") & (F.col("vector") == F.col("class_vector")), "left").select(
        F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component_id.alias("component_id"),
        F.col("vec_id").eqNullSafe(component_id).alias("kept"),
    )
