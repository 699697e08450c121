"""Table functions: operators that SQL calls on temporary views.

``register(spark)`` makes them known to a session::

    SELECT * FROM rake_keywords(TABLE(SELECT doc_id, text FROM documents), text => 'text')

    SELECT * FROM project_vectors(TABLE(vectors), vec => 'embedding', matrix => 'fold', out => 'short')

    SELECT * FROM topk_cells(TABLE(cells), k => 10, exclude_self => true)

Every function takes a TABLE argument with named columns; its result's columns are
worked out from that table and the arguments when the statement is analysed (a
missing column or a wrong type is an error then, not in a task), and so is the
partitioning of ``topk_cells``: all rows of a cell meet in one call.  The others work row by
row and take a PARTITION BY of the caller's.  ``topk_statement`` writes the whole top-k search as SQL over two views:
replicated cells, the function on each cell, and the merge of the cells' lists by rank.

Rows reach a function one at a time, through Arrow; vectors are collected and
multiplied a block at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

from simsift.operators.keywords import STOPWORDS, rake_text
from simsift.operators.topk import _kernel
from simsift.session import ship_package

BLOCK_ROWS = 1024            # rows of one product
MATRIX_BYTES = 64 << 20      # a matrix of more bytes is not shipped with a function
CELL_BYTES = 32 << 20        # of one side's vectors in a cell of the top-k search
MIN_CELLS = 4                # parts of a side


def _columns(table: AnalyzeArgument, name: str) -> T.StructType:
    if not table.isTable:
        raise ValueError(f"{name}: the first argument is a table: TABLE(...)")
    return table.dataType


def _text(argument: AnalyzeArgument | None, name: str, default: str | None = None) -> str:
    if argument is None and default is not None:
        return default
    if argument is None or not argument.isConstantExpression or not isinstance(argument.value, str):
        raise ValueError(f"{name} is the name of a column, as a string literal")
    return argument.value


def _field(schema: T.StructType, column: str, kinds: tuple[type, ...]) -> T.StructField:
    found = next((f for f in schema if f.name == column), None)
    if found is None:
        raise ValueError(f"no column {column!r}; there are {schema.names}")
    if not isinstance(found.dataType, kinds):
        raise ValueError(f"column {column!r} is {found.dataType.simpleString()}")
    return found


class RakeKeywords:
    """``rake_keywords(TABLE(t), text => 'column' [, out => 'keywords'])``: the other
    columns of every row, and the ranked phrases of its text (null for a null text)."""

    @staticmethod
    def analyze(table: AnalyzeArgument, text: AnalyzeArgument, out: AnalyzeArgument | None = None) -> AnalyzeResult:
        schema, column = _columns(table, "rake_keywords"), _text(text, "text")
        _field(schema, column, (T.StringType,))
        made = T.StructType([f for f in schema if f.name != column])
        return AnalyzeResult(made.add(_text(out, "out", "keywords"), T.StringType()))

    def __init__(self):
        self.stop = frozenset(STOPWORDS)

    def eval(self, table, text: str, out: str = "keywords"):
        row = table.asDict(recursive=False)
        said = row.pop(text)
        yield (*row.values(), None if said is None else rake_text(said, self.stop))


def _projector(matrices: dict[str, np.ndarray]) -> type:
    """The class of ``project_vectors`` with its matrices, by name."""

    class ProjectVectors:
        """``project_vectors(TABLE(t), vec => 'column', matrix => 'name' [, out => 'projected'])``: all
        columns, and the vector times the named matrix, in double precision; a null
        vector stays null, another length raises."""

        @staticmethod
        def analyze(table: AnalyzeArgument, vec: AnalyzeArgument, matrix: AnalyzeArgument,
                    out: AnalyzeArgument | None = None) -> AnalyzeResult:
            schema = _columns(table, "project_vectors")
            _field(schema, _text(vec, "vec"), (T.ArrayType,))
            if _text(matrix, "matrix") not in matrices:
                raise ValueError(f"no matrix {matrix.value!r}; there are {sorted(matrices)}")
            return AnalyzeResult(T.StructType(list(schema)).add(_text(out, "out", "projected"), T.ArrayType(T.DoubleType())))

        def __init__(self):
            self.rows, self.vec, self.matrix = [], None, None

        def _flush(self):
            found = [i for i, r in enumerate(self.rows) if r[self.vec] is not None]
            made = [None] * len(self.rows)
            if found:
                vectors = [self.rows[i][self.vec] for i in found]
                if {len(v) for v in vectors} != {len(self.matrix)}:
                    raise ValueError(f"vectors must have {len(self.matrix)} components")
                product = np.asarray(vectors, dtype=np.float64) @ self.matrix
                for i, p in zip(found, product):
                    made[i] = p.tolist()
            for row, product in zip(self.rows, made):
                yield (*row, product)
            self.rows = []

        def eval(self, table, vec: str, matrix: str, out: str = "projected"):
            self.vec, self.matrix = vec, matrices[matrix]
            self.rows.append(table)
            if len(self.rows) == BLOCK_ROWS:
                yield from self._flush()

        def terminate(self):
            if self.rows:
                yield from self._flush()
    return ProjectVectors


class TopkCells:
    """``topk_cells(TABLE(cells), k => 10 [, exclude_self => false])``.

    The table has side (``q`` or ``c``), id, vec, q_cell and c_cell, and is partitioned by the last two.  Of each cell every
    query's best ``k`` candidates by cosine: (query_id, cand_id, score); null vectors are
    skipped, zero vectors score 0, ties go to the smaller id."""

    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument, exclude_self: AnalyzeArgument | None = None) -> AnalyzeResult:
        schema = _columns(table, "topk_cells")
        kind = _field(schema, "id", (T.LongType, T.IntegerType, T.StringType)).dataType
        _field(schema, "side", (T.StringType,))
        _field(schema, "vec", (T.ArrayType,))
        if not k.isConstantExpression or not isinstance(k.value, int) or k.value <= 0:
            raise ValueError("k is a positive literal")
        cell = [PartitioningColumn(_field(schema, c, (T.IntegerType, T.LongType)).name) for c in ("q_cell", "c_cell")]
        return AnalyzeResult(T.StructType().add("query_id", kind).add("cand_id", kind).add("score", T.DoubleType()),
                             partitionBy=cell)

    def __init__(self):
        self.sides = {"q": ([], []), "c": ([], [])}
        self.k, self.exclude_self = 0, False

    def eval(self, table, k: int, exclude_self: bool = False):
        self.k, self.exclude_self = k, exclude_self
        if table["vec"] is not None and table["id"] is not None:
            ids, vectors = self.sides[table["side"]]
            ids.append(table["id"])
            vectors.append(np.asarray(table["vec"], dtype=np.float64))

    def terminate(self):
        (q_ids, q_vecs), (c_ids, c_vecs) = self.sides["q"], self.sides["c"]
        if not q_ids or not c_ids:
            return
        pair = {"q_ids": [q_ids], "q_vecs": [np.concatenate(q_vecs)], "c_ids": [c_ids], "c_vecs": [np.concatenate(c_vecs)]}
        for side, vectors in (("q", q_vecs), ("c", c_vecs)):
            pair |= {f"{side}_dmin": [min(map(len, vectors))], f"{side}_dmax": [max(map(len, vectors))]}
        for found in _kernel(self.k, self.exclude_self)([pd.DataFrame(pair)]):
            yield from found[["query_id", "cand_id", "score"]].itertuples(index=False, name=None)


def register(spark: SparkSession, matrices: dict[str, np.ndarray] | None = None) -> None:
    """Make the table functions known to the session.  ``matrices`` are what
    ``project_vectors`` may name; each is shipped with the function, so it is refused
    over MATRIX_BYTES (``operators.projection`` multiplies by larger ones)."""
    ship_package(spark)
    matrices = {name: np.asarray(m, dtype=np.float64) for name, m in (matrices or {}).items()}
    for name, m in matrices.items():
        if m.nbytes > MATRIX_BYTES:
            raise ValueError(f"matrix {name!r} has {m.nbytes} bytes; a table function may ship {MATRIX_BYTES}")
    for name, made in (("rake_keywords", RakeKeywords), ("project_vectors", _projector(matrices)),
                       ("topk_cells", TopkCells)):
        spark.udtf.register(name, F.udtf(made, useArrow=True))


def topk_cells_of(queries: DataFrame, candidates: DataFrame, query_vec: str, cand_vec: str) -> int:
    """Parts of each side with which a cell of ``topk_statement`` holds at most CELL_BYTES of
    a side's vectors (in double precision)."""
    most = 0
    for df, vec in {(id(d), v): (d, v) for d, v in ((queries, query_vec), (candidates, cand_vec))}.values():
        most = max(most, df.agg(F.sum(8 * F.greatest(F.size(vec), F.lit(0)).cast("long"))).first()[0] or 0)
    return max(MIN_CELLS, -(-most // CELL_BYTES))


def topk_statement(queries: str, candidates: str, k: int, *, query_id: str, query_vec: str, cand_id: str,
                   cand_vec: str, cells: int = 4, exclude_self: bool = False) -> str:
    """The top-k search over two views as one SQL statement: (query_id, cand_id, score,
    rank).  Both sides are cut into ``cells`` parts by id (``topk_cells_of`` tells how many a
    large table needs), and every pair of parts is a cell."""
    def side(tag: str, view: str, id_: str, vec: str, own: str, other: str) -> str:
        return (f"SELECT '{tag}' AS side, `{id_}` AS id, `{vec}` AS vec, "
                f"CAST(pmod(xxhash64(`{id_}`), {cells}) AS INT) AS {own}, {other} "
                f"FROM {view} LATERAL VIEW explode(sequence(0, {cells - 1})) AS {other}")
    both = side("q", queries, query_id, query_vec, "q_cell", "c_cell") + " UNION ALL SELECT side, id, vec, q_cell, c_cell FROM (" \
        + side("c", candidates, cand_id, cand_vec, "c_cell", "q_cell") + ")"
    return f"""
WITH cells AS ({both}),
found AS (SELECT * FROM topk_cells(TABLE(SELECT * FROM cells), k => {k}, exclude_self => {str(exclude_self).lower()})),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS INT) AS rank FROM found)
SELECT query_id, cand_id, score, rank FROM ranked WHERE rank <= {k}"""
