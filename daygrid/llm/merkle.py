"""Document fingerprints as Merkle trees over sections, paragraphs and their pieces. DataFrame functions only.

A text's sections are parted by an empty line, a section's paragraphs by a line break; a paragraph's leaves are its sentences, cut at
64 code points. The leaves of a paragraph, end to end, are the paragraph, so the tree stands for the whole text. A leaf's hash is its
MD5; a paragraph's, a section's and the root's hash cover the whole hashes below. A fingerprint is the root, a colon and the first 12 digits of
the leaf hashes in their order (' ' between leaves, ' , ' between paragraphs, ' / ' between sections). Where roots differ, only branches
that differ need a look: `edits` names their paragraphs by place, from the shown digits (two leaves of one place are mistaken for equal once in
2 ** 48). Likeness is 1 for equal roots, else the shared part of the two trees' distinct
leaves, found by a walk: a branch that both trees have is shared as a whole, and only leaves under other branches are compared.

Documents are put in order in ranges whose borders are quantiles of the ids themselves, so each range has a like number of documents
whatever the ids are; the document at a border goes to both ranges, as the first of one and as the follower of the other's last.

Defined results: a null text is empty; an empty text has a root over one empty paragraph and no leaves, likeness of two trees
without leaves but other roots is 0; ties of doc_id (repeated rows) are ordered by text; a null doc_id comes first; the only
document of a table is its own next; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

LEAF = 64
HASH = 12
#: Documents that one window puts in order, on average, and ranges at most: beyond them ranges grow.
BUCKET_ROWS = 1024
RANGES = 10_000


def tree(text: Column) -> Column:
    """The leaf hashes of a text in their order, whole."""

    def paragraph(p: Column) -> Column:
        pieces = F.regexp_extract_all(F.regexp_replace(p, r"([.!?]) ", "$1 \n"), F.lit(f"[^\n]{{1,{LEAF}}}"), F.lit(0))
        return F.array_join(F.transform(pieces, F.md5), " ")

    def section(s: Column) -> Column:
        return F.array_join(F.transform(F.split(s, "\n"), paragraph), " , ")

    return F.array_join(F.transform(F.split(text, "\n\n"), section), " / ")


def shown(t: Column) -> Column:
    """The tree with the first digits of each leaf's hash."""
    return F.regexp_replace(t, f"([0-9a-f]{{{HASH}}})[0-9a-f]{{{32 - HASH}}}", "$1")


def section_hashes(t: Column) -> Column:
    """Array of structs (hash, paragraphs: array of hashes) of a tree."""
    paragraphs = F.transform(F.split(t, " / "), lambda s: F.transform(F.split(s, " , "), lambda p: F.md5(p)))
    return F.transform(paragraphs, lambda ps: F.struct(F.md5(F.array_join(ps, "")).alias("hash"), ps.alias("paragraphs")))


def root(t: Column) -> Column:
    return F.sha2(F.array_join(F.transform(section_hashes(t), lambda s: s["hash"]), ""), 256)


def leaves(t: Column) -> Column:
    return F.filter(F.split(t, " "), lambda x: F.length(x) >= HASH)


def likeness(a: Column, b: Column, root_a: Column, root_b: Column) -> Column:
    """Of two trees, 0 to 1: 1 for equal roots, else by a walk from the sections down. A branch is named by its hash and what it holds."""
    branch = lambda x: F.concat(F.md5(x), F.lit(":"), x)
    inside = lambda x: F.substring(x, 34, 1 << 30)
    sections = lambda t: F.transform(F.split(t, " / "), branch)
    paragraphs = lambda s: F.flatten(F.transform(s, lambda x: F.transform(F.split(inside(x), " , "), branch)))
    under = lambda p: F.flatten(F.transform(p, lambda x: leaves(inside(x))))

    def compare(s: Column) -> Column:
        whole, pa, pb = F.array_intersect(s["a"], s["b"]), paragraphs(F.array_except(s["a"], s["b"])), paragraphs(F.array_except(s["b"], s["a"]))

        def deeper(p: Column) -> Column:
            equal = F.array_intersect(p["a"], p["b"])
            rest = F.array_intersect(under(F.array_except(p["a"], p["b"])), under(F.array_except(p["b"], p["a"])))
            return F.size(F.array_distinct(F.concat(under(paragraphs(p["whole"])), under(equal), rest)))

        return let(F.struct(pa.alias("a"), pb.alias("b"), whole.alias("whole")), deeper)

    shared = let(F.struct(sections(a).alias("a"), sections(b).alias("b")), compare)
    every = F.size(F.array_distinct(leaves(a))) + F.size(F.array_distinct(leaves(b)))
    part = let(shared, lambda n: F.when(every - n > 0, n.cast("double") / (every - n)).otherwise(0.0))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(part)


def differing(a: Column, b: Column) -> Column:
    """Where two trees part: array of (section, paragraph) numbers, from 0, of the paragraphs that differ by place. Sections with
    equal hashes are not entered."""
    empty = F.array().cast("array<string>")

    def inside(x: Column, y: Column, i: Column) -> Column:
        left, right = F.coalesce(x["paragraphs"], empty), F.coalesce(y["paragraphs"], empty)
        numbers = F.sequence(F.lit(0), F.greatest(F.size(left), F.size(right)) - 1)
        return F.transform(F.filter(numbers, lambda j: ~F.get(left, j).eqNullSafe(F.get(right, j))), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    pairs = F.zip_with(section_hashes(a), section_hashes(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    parts = F.transform(pairs, lambda p, i: F.when(~p["x"]["hash"].eqNullSafe(p["y"]["hash"]), inside(p["x"], p["y"], i)))
    return F.flatten(F.filter(parts, lambda p: p.isNotNull()))


def edits(a: Column, b: Column, root_a: Column, root_b: Column) -> Column:
    """The places that `differing` finds, as 'section:paragraph' with spaces between; trees of equal roots are not entered."""
    places = F.transform(differing(a, b), lambda x: F.concat_ws(":", x["section"].cast("string"), x["paragraph"].cast("string")))
    return F.when(root_a == root_b, F.lit("")).otherwise(F.array_join(places, " "))


def borders(docs: DataFrame, rows: int = BUCKET_ROWS) -> list[int]:
    """Ids that part the documents into ranges of a like number: quantiles, each an id of the table."""
    n = docs.filter("doc_id is not null").count()
    k = max(1, min(RANGES, n // rows))
    at = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / k for i in range(1, k)] or [0.5], 20 * k)).first()[0] if n else None
    return sorted(set(at or [])) if k > 1 else []


def bucket_of(doc_id: Column, at: list[int]) -> Column:
    """Number of borders that are not above the id; found in a coarse list first, then among those between two of it."""
    if not at:
        return F.lit(0)
    step = max(1, int(len(at) ** 0.5))
    fine = [at[i : i + step] for i in range(0, len(at), step)]
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in part]) for part in fine])
    below = lambda a: F.size(F.filter(a, lambda x: x <= doc_id))
    coarse = below(F.array(*[F.lit(part[0]).cast("long") for part in fine]))
    return F.when(doc_id.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + below(F.get(table, coarse - 1)))


def with_next(docs: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text, root, tree (shown), and next_text, next_root and next_tree of the next document by id (after the last, the first)."""
    at = borders(docs, rows)
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", text.alias("text"), bucket_of(doc_id, at).alias("own"))
    # The first document of a range follows the last of the range before, the first of all that of the last range.
    low = docs.agg(F.min(doc_id), F.count_if(F.col("doc_id").isNull())).first()
    first = F.col("doc_id").isNull() if low[1] else F.col("doc_id") == F.lit(low[0])
    starts = F.when(first, len(at)).when(F.col("doc_id").cast("long").isin(at) if at else F.lit(False), F.col("own") - 1)
    put = F.array_compact(F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest")), F.when(starts.isNotNull(), F.struct(starts.alias("bucket"), F.lit(1).alias("guest")))))
    hashed = own.withColumn("full", tree(F.col("text"))).select("doc_id", "text", root(F.col("full")).alias("root"), shown(F.col("full")).alias("tree"), "own")
    rows_ = hashed.withColumn("at", F.explode(put)).select("doc_id", "text", "root", "tree", "at.bucket", "at.guest")
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    placed = rows_.withColumn("next_text", F.lead("text").over(order)).withColumn("next_root", F.lead("root").over(order)).withColumn("next_tree", F.lead("tree").over(order))
    return placed.filter("guest = 0").select("doc_id", "text", "root", "tree", "next_text", "next_root", "next_tree")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_at (the places where the edited text differs)."""
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    df = with_next(docs)
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k)))
    df = df.withColumn("full", tree(F.col("edited"))).withColumn("edited_tree", shown(F.col("full"))).withColumn("edited_root", root(F.col("full")))
    edited = F.col("tree"), F.col("edited_tree"), F.col("root"), F.col("edited_root")
    return df.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.concat("root", F.lit(":"), "tree").alias("fingerprint"),
        F.concat("edited_root", F.lit(":"), "edited_tree").alias("edited_fingerprint"),
        likeness(*edited).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree"), F.col("root"), F.col("next_root")).alias("near_next"),
        edits(*edited).alias("edited_at"),
    )


SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, lead(coalesce(text, '')) over (order by doc_id, text) as nx from documents),
e as (select doc_id, text, coalesce(nx, (select text from d order by doc_id, text limit 1)) as nx, length(text) as n from d),
f as (select *, left(text, n - n // 4) || left(nx, n // 4) as edited from e),
w as (select *, {{tree_text}} as full_tree, {{tree_edited}} as full_edited, {{tree_nx}} as full_next from f),
g as (select *, {{short_full_tree}} as tree, {{short_full_edited}} as edited_tree, {{short_full_next}} as next_tree from w),
h as (select *, {{root_full_tree}} as r, {{root_full_edited}} as er, {{root_full_next}} as nr,
  list_filter(string_split(tree, ' '), lambda x: length(x) = {HASH}) as l, list_filter(string_split(edited_tree, ' '), lambda x: length(x) = {HASH}) as el,
  list_filter(string_split(next_tree, ' '), lambda x: length(x) = {HASH}) as nl from g)
select doc_id, cast(n as bigint) as n_chars, sha256(edited) as edited_sha256, r || ':' || tree as fingerprint, er || ':' || edited_tree as edited_fingerprint,
 case when r = er then 1.0::double when len(list_distinct(list_concat(l, el))) = 0 then 0.0::double
  else len(list_intersect(l, el))::double / len(list_distinct(list_concat(l, el))) end as near_edited,
 case when r = nr then 1.0::double when len(list_distinct(list_concat(l, nl))) = 0 then 0.0::double
  else len(list_intersect(l, nl))::double / len(list_distinct(list_concat(l, nl))) end as near_next,
 case when r = er then '' else array_to_string(flatten(list_transform(range(1, greatest(len(string_split(tree, ' / ')), len(string_split(edited_tree, ' / '))) + 1), lambda i:
  list_transform(list_filter(range(1, greatest(coalesce(len(string_split(string_split(tree, ' / ')[i], ' , ')), 0), coalesce(len(string_split(string_split(edited_tree, ' / ')[i], ' , ')), 0)) + 1),
   lambda j: string_split(string_split(tree, ' / ')[i], ' , ')[j] is distinct from string_split(string_split(edited_tree, ' / ')[i], ' , ')[j]), lambda j: (i - 1) || ':' || (j - 1)))), ' ') end as edited_at
from h
"""


def oracle() -> str:
    def tree_sql(c: str) -> str:
        leaf = f"list_transform(regexp_extract_all(regexp_replace(p, '([.!?]) ', '\\1 ' || chr(10), 'g'), '[^\\n]{{1,{LEAF}}}'), lambda y: md5(y))"
        return f"array_to_string(list_transform(string_split({c}, chr(10) || chr(10)), lambda s: array_to_string(list_transform(string_split(s, chr(10)), lambda p: array_to_string({leaf}, ' ')), ' , ')), ' / ')"

    def root_sql(c: str) -> str:
        return f"sha256(array_to_string(list_transform(string_split({c}, ' / '), lambda s: md5(array_to_string(list_transform(string_split(s, ' , '), lambda p: md5(p)), ''))), ''))"

    def short_sql(c: str) -> str:
        return f"regexp_replace({c}, '([0-9a-f]{{{HASH}}})[0-9a-f]{{{32 - HASH}}}', '\\1', 'g')"

    trees = {f"tree_{c}": tree_sql(c) for c in ("text", "edited", "nx")}
    return SQL.format(**trees, **{f"short_{c}": short_sql(c) for c in ("full_tree", "full_edited", "full_next")}, root_full_tree=root_sql("full_tree"), root_full_edited=root_sql("full_edited"), root_full_next=root_sql("full_next"))
