"""Name resolution: references to declarations, with a confidence that is spread over the candidates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.schema import IMPLEMENTS_CONFIDENCE, SPREAD
from lattica.sources.scratch import settle


def _edges(found: DataFrame, confidence: Column) -> DataFrame:
    return found.select(F.col("caller_id").alias("src"), F.col("symbol_id").alias("dst"), F.lit("CALLS").alias("kind"), F.lit("syntactic").alias("provenance"), confidence.alias("confidence"), "location")


def spread(ref: str = "ref_id") -> Column:
    return F.lit(SPREAD) / F.count(F.lit(1)).over(Window.partitionBy(ref))


#: How many rows of a product a task makes, and how many rows of each side meet at once in it.
TASK_ROWS, BLOCK = 20_000_000, 1000


def product(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of left and right that agree in key, as a join gives them, for few keys with many rows each.

    The rows of a key are dealt to blocks by a hash, on either side, and blocks meet in tasks of some TASK_ROWS results, however many a key has.
    What is shuffled is a thousandth of the results on either side. Both frames are read twice.
    """
    count = lambda df, c: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(c))
    sizes = settle(count(left, "__l").join(count(right, "__r"), key), "sizes")
    total = sizes.agg(F.coalesce(F.sum(F.col("__l").cast("double") * F.col("__r")), F.lit(0.0))).first()[0]
    if total <= TASK_ROWS:
        return left.join(right, key)
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(min(total // TASK_ROWS + 1, 100_000)))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK)

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        at = df.join(sizes, key).withColumn(mine, F.pmod(F.xxhash64(*df.columns), blocks(own)))
        at = at.select(*df.columns, mine, F.explode(F.sequence(F.lit(0).cast("long"), blocks(other) - 1)).alias(theirs))
        return at.repartition(tasks, key, "__a", "__b")

    found = dealt(left, "__l", "__r", "__a", "__b").hint("merge").join(dealt(right, "__r", "__l", "__b", "__a"), [key, "__a", "__b"])
    return found.drop("__a", "__b")


class References(NamedTuple):
    """References and what they may mean, factorised: a reference names a class of candidates, whose members stand beside it.

    refs: ref_id, caller_id, location, cls, n (the class's size), confidence; members: cls, symbol_id.
    """

    refs: DataFrame
    members: DataFrame

    def edges(self, kept: bool = False) -> DataFrame:
        """CALLS of every reference to every candidate: as many rows as references times candidates, made in tasks of bounded size.

        References are written before, so that what they have is made once each, not once a row; kept: both frames are on disk, or cheap to make twice.
        """
        refs, members = self.refs.select("caller_id", "location", "cls", "confidence"), self.members.select("cls", "symbol_id")
        if not kept:
            refs, members = settle(refs, "references"), settle(members, "members")
        return _edges(product(refs, members, "cls"), F.col("confidence"))

    def spread(self) -> DataFrame:
        """ref_id, n, confidence: of every reference that has candidates how many, and what each gets; a row a reference, none a candidate."""
        return self.refs.select("ref_id", "n", "confidence")

    def number(self) -> int:
        """How many rows edges has, by counts of references and members by class."""
        n = lambda df, c: df.groupBy("cls").agg(F.count(F.lit(1)).alias(c))
        return n(self.refs, "a").join(n(self.members, "b"), "cls").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]


def references(refs: DataFrame, decls: DataFrame, repo_wide: Column | None = None) -> References:
    """References by the nearest scope that declares their name: the file, else its directory, else (where repo_wide holds) the repository.

    A class is a name in a scope, so that references and declarations are joined by counts only, a row for each name and scope: what is
    made has at most as many rows as there are references, and three times as many as declarations.
    """
    wide = F.lit(True) if repo_wide is None else repo_wide
    scope = {0: "file_id", 1: "dir", 2: None}
    name = lambda tier, of, callee: F.concat_ws("\x01", F.lit(tier), *([of] if of is not None else []), callee)
    members = [decls.select(name(t, F.col(c) if c else None, F.col("name")).alias("cls"), "symbol_id") for t, c in scope.items()]
    # written, so that their sizes are known and small tables are broadcast: references are shuffled for large ones only
    sizes = [settle(m.groupBy("cls").agg(F.count(F.lit(1)).alias("n")), "classes") for m in members]
    told = refs.select("ref_id", "caller_id", "location", "file_id", "dir", "callee", wide.alias("__wide"))
    key = lambda t: name(t, F.col(scope[t]) if scope[t] else None, F.col("callee"))
    for t, of in enumerate(sizes):
        told = told.withColumn("cls", key(t) if t < 2 else F.when(F.col("__wide"), key(t))).join(of.withColumnRenamed("n", f"n_{t}"), "cls", "left").drop("cls")
    n = F.coalesce("n_0", "n_1", "n_2")
    cls = F.when(F.col("n_0").isNotNull(), key(0)).when(F.col("n_1").isNotNull(), key(1)).otherwise(key(2))
    out = told.where(n.isNotNull()).select("ref_id", "caller_id", "location", cls.alias("cls"), n.alias("n"), (F.lit(SPREAD) / n).alias("confidence"))
    return References(out, members[0].unionByName(members[1]).unionByName(members[2]))


def resolve_tiers(refs: DataFrame, decls: DataFrame, repo_wide: Column | None = None) -> DataFrame:
    """CALLS to the candidates of the nearest scope that has any, all of them, a row each."""
    return references(refs, decls, repo_wide).edges()


def resolve_imported(refs: DataFrame, import_dirs: DataFrame, decls: DataFrame) -> DataFrame:
    """CALLS of qualified names: declarations of the name in a directory of the import. refs has import_path; import_dirs: import_path, dir.

    A class is a name of an import, so that what is shuffled grows with references and declarations; only the last join makes a row a candidate.
    Rows that repeat a reference count once.
    """
    asked = settle(refs.select("ref_id", "caller_id", "location", "import_path", "callee").distinct(), "asked")  # read twice
    named = asked.select("import_path", "callee").distinct().join(import_dirs.select("import_path", "dir").distinct(), "import_path")
    members = named.join(decls.select(F.col("name").alias("callee"), "dir", "symbol_id").distinct(), ["callee", "dir"]).select(_import_class(), "symbol_id").distinct()
    sizes = settle(members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")), "classes")
    found = asked.withColumn("cls", _import_class()).join(sizes, "cls").select("ref_id", "caller_id", "location", "cls", "n", (F.lit(SPREAD) / F.col("n")).alias("confidence"))
    return References(settle(found, "references"), members).edges(kept=True)


def _import_class() -> Column:
    return F.to_json(F.struct("import_path", "callee")).alias("cls")


def methods_by_name(refs: DataFrame, methods: DataFrame) -> References:
    """References by a method's bare name, wherever in the repository, factorised: a class is a name. methods: name, symbol_id."""
    members = methods.where("name IS NOT NULL").select(F.col("name").alias("cls"), "symbol_id")
    sizes = settle(members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")), "classes")
    found = refs.select("ref_id", "caller_id", "location", F.col("callee").alias("cls")).join(sizes, "cls")
    return References(found.select("ref_id", "caller_id", "location", "cls", "n", (F.lit(SPREAD) / F.col("n")).alias("confidence")), members)


def resolve_methods(refs: DataFrame, methods: DataFrame) -> DataFrame:
    """CALLS by a method's bare name, a row each."""
    return methods_by_name(refs, methods).edges()


def import_dirs(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """import_path, dir: of the modules (module, root) that are the longest prefix of the import at a slash, all ties, the directory that it names.

    Each import is exploded into its prefixes, so the prefix join is an equi-join.
    """
    parts = F.split("import_path", "/")
    prefixes = imports.select("import_path").distinct().select("import_path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"))
    prefixes = prefixes.withColumn("module", F.array_join(F.slice(F.split("import_path", "/"), F.lit(1), F.col("n")), "/"))
    hit = prefixes.join(modules, "module")
    longest = F.rank().over(Window.partitionBy("import_path").orderBy(F.desc("n")))
    rest = F.substring(F.col("import_path"), F.length("module") + 2, F.length("import_path"))
    joined = F.when(rest == "", F.col("root")).when(F.col("root") == "", rest).otherwise(F.concat_ws("/", "root", rest))
    return hit.withColumn("r", longest).where("r = 1").select("import_path", joined.alias("dir")).distinct()


def import_edges(imports: DataFrame, dirs: DataFrame, files: DataFrame) -> DataFrame:
    """IMPORTS of a file to every other file in each directory of its import; confidence is split over the directories, not the files."""
    n = dirs.groupBy("import_path").agg(F.countDistinct("dir").alias("n_dirs"))
    # files by the set of their directories, so that nothing is made twice and the product needs no distinct
    placed = files.where("file_id IS NOT NULL").groupBy(F.col("file_id").alias("dst")).agg(F.to_json(F.sort_array(F.collect_set("dir"))).alias("cls"))
    placed = settle(placed, "places")
    places = placed.select("cls").distinct().select("cls", F.explode(F.from_json("cls", "array<string>")).alias("dir"))
    asked = imports.select(F.col("file_id").alias("src"), "import_path").distinct().join(dirs, "import_path").join(n, "import_path")
    asked = asked.select("src", (SPREAD / F.greatest(F.lit(1), "n_dirs")).alias("confidence"), "dir").distinct()
    asked = settle(asked.join(places, "dir").select("src", "confidence", "cls").distinct(), "imports")
    rows = product(asked, placed, "cls").where("src <> dst")
    return rows.select("src", "dst", F.lit("IMPORTS").alias("kind"), F.lit("syntactic").alias("provenance"), "confidence", F.lit(None).cast("string").alias("location"))


class Matches(NamedTuple):
    """IMPLEMENTS in classes: types: type_id, type_set; interfaces: iface_id, iface_set; pairs: type_set, iface_set, of which one holds the other."""

    types: DataFrame
    interfaces: DataFrame
    pairs: DataFrame

    def edges(self) -> DataFrame:
        held = settle(self.pairs.join(self.interfaces, "iface_set").select("type_set", "iface_id"), "held")  # a row a distinct set and interface
        found = product(self.types, held, "type_set")
        return found.select(F.col("type_id").alias("src"), F.col("iface_id").alias("dst"), F.lit("IMPLEMENTS").alias("kind"), F.lit("syntactic").alias("provenance"), F.lit(IMPLEMENTS_CONFIDENCE).alias("confidence"), F.lit(None).cast("string").alias("location"))


def signatures(rows: DataFrame, key: str, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """key, set of every owner of names, and set, names (sorted, distinct) of every distinct set; set is their digest."""
    owned = rows.groupBy(key).agg(F.sort_array(F.collect_set(F.col(name).cast("string"))).alias("names"))
    owned = owned.withColumn("set", F.sha2(F.to_json("names"), 256))
    return owned.select(key, "set"), owned.groupBy("set").agg(F.first("names").alias("names"))


def matches(methods: DataFrame, interfaces: DataFrame) -> Matches:
    """Which method sets of types (type_id, name) hold which of interfaces (iface_id, name), by their distinct sets; empty interfaces match nothing.

    Sets meet in an index at an interface's rarest method, counted over distinct sets; equal sets are compared once, however many own them.
    """
    types, kinds = signatures(methods.where("name IS NOT NULL"), "type_id")
    faces, wanted = signatures(interfaces.where("name IS NOT NULL"), "iface_id")
    types, faces, kinds, wanted = (settle(x, "signatures") for x in (types, faces, kinds, wanted))
    index = kinds.select(F.col("set").alias("type_set"), F.col("names").alias("has"), F.explode("names").alias("name"))
    common = index.groupBy("name").agg(F.count(F.lit(1)).alias("sets"))
    each = wanted.select(F.col("set").alias("iface_set"), F.col("names").alias("needs"), F.explode("names").alias("name")).join(common, "name")
    rarest = each.groupBy("iface_set").agg(F.first("needs").alias("needs"), F.min(F.struct("sets", "name")).alias("r"), F.count(F.lit(1)).alias("known"))
    rarest = rarest.where(F.col("known") == F.size("needs")).select("iface_set", "needs", F.col("r.name").alias("name"))  # a method that no type has: none
    pairs = rarest.join(index, "name").where(F.size(F.array_except("needs", "has")) == 0).select("type_set", "iface_set")
    return Matches(types.withColumnRenamed("set", "type_set"), faces.withColumnRenamed("set", "iface_set"), settle(pairs, "matches"))


def implements(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """IMPLEMENTS of types whose method set (type_id, name) holds all of an interface's (iface_id, name), a row each."""
    return matches(methods, interfaces).edges()


def interface_closure(direct: DataFrame, embeds: DataFrame, blocked: DataFrame, rounds: int = 32) -> DataFrame:
    """iface_id, name of all methods of an interface with those of what it embeds; interfaces that are blocked, or embed one that is, or lie on a cycle, have none.

    direct: iface_id, name; embeds: iface_id, embedded; blocked: iface_id. A fixed point over the embedding; paths double with each round,
    so that rounds are the logarithm of how deep interfaces nest, and one that isn't reached is an error.
    """
    reach = settle(embeds.select("iface_id", "embedded").distinct(), "embeddings")
    size = reach.count()
    for _ in range(rounds):
        further = reach.join(reach.select(F.col("iface_id").alias("embedded"), F.col("embedded").alias("next")), "embedded").select("iface_id", F.col("next").alias("embedded"))
        reach = settle(reach.unionByName(further).distinct(), "embeddings")
        before, size = size, reach.count()
        if before == size:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    bad = blocked.select("iface_id").unionByName(reach.where("iface_id = embedded").select("iface_id")).distinct()
    bad = bad.unionByName(reach.join(bad.select(F.col("iface_id").alias("embedded")), "embedded").select("iface_id")).distinct()
    inherited = reach.join(direct.select(F.col("iface_id").alias("embedded"), "name"), "embedded").select("iface_id", "name")
    return direct.select("iface_id", "name").unionByName(inherited).distinct().join(bad, "iface_id", "left_anti")
