"""Types, vocabularies and limits, in one place."""

from pyspark.sql import types as T

_s, _l, _d = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODES = _struct(repo=_s, rev=_s, id=_s, kind=_s, name=_s, path=_s, committed_at=_l)
EDGES = _struct(repo=_s, rev=_s, edge_seq=_s, src=_s, dst=_s, kind=_s, provenance=_s, confidence=_d, location=_s)
DOCS = _struct(repo=_s, node_id=_s, kind=_s, name=_s, path=_s, content=_s)
MANIFEST = _struct(schema_version=T.IntegerType(), commit=_s, **{"pass": _s}, counts=_struct(nodes=_l, edges=_l), segments=T.MapType(_s, _struct(sha256=_s, bytes=_l)))

# Closed vocabularies of the data model.
NODE_KINDS = ("File", "Symbol", "Package", "Commit", "Contributor")
PREFIXES = {"File": "file", "Symbol": "sym", "Package": "pkg", "Commit": "commit", "Contributor": "contributor"}
EDGE_KINDS = ("DEFINES", "CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "TOUCHES", "AUTHORED")
PROVENANCES = ("precise", "syntactic", "extracted", "inferred")
DIRECTIONS = ("in", "out", "both")
JOB_KINDS = ("fetch", "index")

# Limits of the bounded operations.
SCHEMA_VERSION = 7
NODE_CAP, BUDGET, PAGE_EDGE_CAP = 1000, 10_000, 10_000
MAX_DEPTH, MAX_LIMIT, TOP_K, MAX_OFFSET = 3, 1000, 1000, 1000
FUZZY_CAP, UNADDRESSABLE = 25, 256
SPREAD, IMPLEMENTS_CONFIDENCE = 0.9, 0.5
FILE_BYTES, BODY_BYTES, TOKEN_BYTES = 1 << 20, 512 << 10, 65_530
QUERY_BYTES, QUERY_DEPTH = 1024, 8


class VerbError(ValueError):
    """A client's error; code is the one of the closed taxonomy."""

    def __init__(self, code: str, text: str) -> None:
        super().__init__(text)
        self.code = code
