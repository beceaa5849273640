"""Addressable units of structured legal texts, as window jobs over lines.

A text is a table of lines. Headings open islands (articles, numbered parts, positions, annexes), found by running
counts over a document's lines; grouping by island gives blocks with a label, a citation and an anchor. Rules that
need a block's size or its neighbours are conditions over the grouped rows. Blocks over the soft maximum are cut by
`cut_blocks`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fn
from ..functions.pieces import fit, pack, sentences, slices

TARGET, LEAST = 800, 80

#: Patterns of headings.
ARTICLE = r"(?U)^Статья\s+(\d+(?:\.\d+)?)\.\s*(.*)$"
SECTION = r"(?U)^§\s*\d+"
PART = r"(?U)^(\d+(?:\.\d+)?)\.\s+\S"
POINT = r"(?U)^(\d+(?:\(\d+\))?)\.\s+\S"
POSITION_LINE = r"(?U)^Позиция\s+(\d+)\s*$"
POSITION_INLINE = r"""(?U)^(\d{1,3})\.\s*(?=[А-ЯЁ«"])(.+)$"""
APPENDIX = r"(?U)^Приложение\s+N\s*(\d+)\s*$"
STAMP = r"(?iU)^утвержден[оаы]?$"
STAMP_END = r"(?U)\bN\s*\d+\s*$"
ROMAN = r"(?U)^(?:I{1,3}|IV|VI{0,3}|IX|X)\.\s+\S"
SIGNATURE = r"(?U)^Уполномоченное лицо\b"
#: What an approved act is by its title in upper case, the first that matches: (pattern, slug, kind, label, short label).
ACTS = (
    (r"^ПОЛОЖЕНИЕ\b", "regulation", "regulation", "Положение о независимых гарантиях", ""),
    (r"ПЕРЕЧЕНЬ ДОКУМЕНТОВ", "document_list", "rules", "Перечень документов, представляемых заказчиком гаранту", "перечень документов"),
    (r"ДОПОЛНИТЕЛЬНЫЕ ТРЕБОВАНИЯ", "requirements", "rules", "Дополнительные требования к независимой гарантии", "дополнительные требования"),
    (r"ПРАВИЛА ФОРМИРОВАНИЯ И ВЕДЕНИЯ ЗАКРЫТОГО РЕЕСТРА", "closed_registry_rules", "rules", "Правила формирования и ведения закрытого реестра независимых гарантий", "правила закрытого реестра"),
    (r"ПРАВИЛА ВЕДЕНИЯ И РАЗМЕЩЕНИЯ", "registry_rules", "rules", "Правила ведения и размещения реестра независимых гарантий", "правила ведения реестра"),
    (r"ТИПОВАЯ ФОРМА.*ЗАЯВК", "bid_guarantee_form", "form", "Типовая форма независимой гарантии (обеспечение заявки)", "типовая форма обеспечения заявки"),
    (r"ТИПОВАЯ ФОРМА.*ИСПОЛНЕНИ", "contract_guarantee_form", "form", "Типовая форма независимой гарантии (обеспечение исполнения {subject})", "типовая форма обеспечения исполнения {subject}"),
    (r"ФОРМА ТРЕБОВАНИЯ", "payment_demand_form", "form", "Форма требования об уплате денежной суммы по независимой гарантии", "форма требования об уплате"),
    (r"ТРЕБОВАНИЕ.*ЗАЯВК", "bid_demand_form", "form", "Форма требования об уплате (обеспечение заявки)", "форма требования (обеспечение заявки)"),
    (r"ТРЕБОВАНИЕ.*ИСПОЛНЕНИ", "contract_demand_form", "form", "Форма требования об уплате (обеспечение исполнения {subject})", "форма требования (обеспечение исполнения {subject})"),
)
TITLE_LINES = 7


#: Bytes of text that a task's windows sort.
PART_BYTES = 16_000_000


def spread(docs: DataFrame) -> DataFrame:
    """The documents over as many partitions as their texts need, so that a task's share doesn't grow with the corpus: sizes after compression say little of texts that repeat themselves."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), "doc_id")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, prefix, pos, line) of documents with doc_id, text and prefix (how a document is cited), a document in one partition."""
    return spread(docs.select("doc_id", "prefix", "text")).select("doc_id", "prefix", F.posexplode(fn.normalize_lines(F.coalesce(F.col("text"), F.lit("")))).alias("pos", "line"))


def _over(*by: str):
    return Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _number(pattern: str, group: int = 1) -> Column:
    return F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, group))


def _in_order(lines: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("pos", lines.alias("line")))), lambda x: x["line"])


def articles(docs: DataFrame, part_name: str, part_slug: str, whole: bool) -> DataFrame:
    """(doc_id, pos, lines, label, citation, anchor, article, part, section): articles and their numbered parts.

    whole: an article within the soft maximum stays one block; else every numbered part is one. Short lines before the first
    part join it. Section marks only name what follows.
    """
    rows = lines_of(docs).filter("line <> ''").withColumns({"mark": F.when(F.col("line").rlike(SECTION), F.col("line")), "article": _number(ARTICLE), "title": F.trim(_number(ARTICLE, 2))})
    rows = rows.withColumn("section", F.last("mark", True).over(_over("doc_id"))).filter("mark is null")
    rows = rows.withColumn("a", F.count("article").over(_over("doc_id"))).withColumn("part", F.when(F.col("article").isNull() & (F.col("a") > 0), _number(PART)))
    rows = rows.withColumn("p", F.count("part").over(_over("doc_id", "a")))
    by = Window.partitionBy("doc_id", "a")
    head = lambda c: F.max(F.when(F.col("article").isNotNull(), F.col(c))).over(by)
    rows = rows.withColumns({"a_no": head("article"), "a_title": head("title"), "a_section": head("section"), "heading": head("line")})
    body = rows.filter("article is null")
    chars = lambda w: F.sum(F.length("line") + 1).over(w) - 1
    body = body.withColumns({"size": chars(by), "parts": F.max("p").over(by), "lead": chars(Window.partitionBy("doc_id", "a", "p"))})
    one = F.lit(False) if not whole else F.col("size") <= TARGET * 3 // 2
    group = F.when(one | (F.col("parts") == 0) | (F.col("a") == 0), -1).when((F.col("p") == 0) & (F.col("lead") < LEAST), 1).otherwise(F.col("p"))
    body = body.withColumn("g", group).groupBy("doc_id", "prefix", "a", "g").agg(
        F.min("pos").alias("pos"), _in_order(F.col("line")).alias("lines"), F.min(F.when(F.col("g") > 0, F.col("part"))).alias("part"), *[F.first(c).alias(c) for c in ("a_no", "a_title", "a_section")]
    )
    empty = rows.groupBy("doc_id", "prefix", "a").agg(F.min("pos").alias("pos"), F.first("heading").alias("heading"), F.first("a_no").alias("a_no"), F.first("a_section").alias("a_section"), F.count_if(F.col("article").isNull()).alias("n")).filter("n = 0")
    empty = empty.select("doc_id", "prefix", "a", F.lit(-1).alias("g"), "pos", F.array("heading").alias("lines"), F.lit(None).cast("string").alias("part"), "a_no", F.lit("").alias("a_title"), "a_section")
    both = body.unionByName(empty)
    label = F.concat(F.lit("Статья "), "a_no", F.when(F.coalesce("a_title", F.lit("")) != "", F.concat(F.lit(". "), "a_title")).otherwise(F.lit("")))
    tail = lambda before: F.when(F.col("part").isNull(), "").otherwise(F.concat(F.lit(before), "part"))
    pre = F.col("a") == 0
    return both.select(
        "doc_id", "pos", "lines", F.when(pre, "Вступительная часть").otherwise(F.concat(label, tail(f" — {part_name} "))).alias("label"),
        F.concat("prefix", F.when(pre, ", вступительная часть").otherwise(F.concat(F.lit(", ст. "), "a_no", tail(f", {part_name} ")))).alias("citation"),
        F.when(pre, "preamble").otherwise(F.concat(F.lit("art."), "a_no", tail(f"/{part_slug}."))).alias("anchor"), F.col("a_no").alias("article"), "part", F.col("a_section").alias("section"),
    )


def civil_code(docs: DataFrame) -> DataFrame:
    return articles(docs, "п.", "point", whole=True)


def federal_law(docs: DataFrame) -> DataFrame:
    return articles(docs, "ч.", "part", whole=False)


def court_review(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, lines, label, citation, anchor, position, section): the positions of a review of court practice.

    Positions have lines of their own, or where there are none, numbers that only grow: a number counts if it exceeds all before.
    """
    rows = lines_of(docs).filter("line <> ''").withColumns({"own": _number(POSITION_LINE).cast("int"), "inline": _number(POSITION_INLINE).cast("int")})
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"styled": F.count("own").over(Window.partitionBy("doc_id")) > 0, "top": F.coalesce(F.max("inline").over(before), F.lit(0))})
    start = F.when(F.col("styled"), F.col("own")).otherwise(F.when(F.col("inline") > F.col("top"), F.col("inline")))
    rows = rows.withColumn("start", start).withColumn("k", F.count("start").over(_over("doc_id")))
    rows = rows.withColumn("last", F.col("pos") == F.max("pos").over(Window.partitionBy("doc_id", "k")))
    title = (F.col("k") == 0) & F.col("last") & fn.is_all_caps(F.col("line"))
    section = F.max(F.when(title, F.col("line"))).over(Window.partitionBy("doc_id"))
    kept = rows.withColumn("section", section).filter(~title & ~(F.col("styled") & F.col("start").isNotNull()))
    numbers = rows.filter("start is not null").select("doc_id", "k", F.col("start").alias("position"))
    grouped = kept.groupBy("doc_id", "prefix", "k").agg(F.min("pos").alias("pos"), _in_order(F.col("line")).alias("lines"), F.first("section").alias("section"), F.first("styled").alias("styled"))
    opening = F.element_at("lines", 1)
    said = F.when(F.col("styled"), opening).otherwise(F.regexp_extract(opening, POSITION_INLINE, 2))
    thesis = fn.truncate_words(_first_sentence(said), 300)
    pre = F.col("k") == 0
    return grouped.join(numbers, ["doc_id", "k"], "left").select(
        "doc_id", "pos", "lines", F.when(pre, "Вводная часть обзора").otherwise(F.concat(F.lit("Позиция "), F.col("position").cast("string"), F.lit(". "), thesis)).alias("label"),
        F.concat("prefix", F.when(pre, ", вводная часть").otherwise(F.concat(F.lit(", позиция "), F.col("position").cast("string")))).alias("citation"),
        F.when(pre, "preamble").otherwise(F.concat(F.lit("pos."), F.col("position").cast("string"))).alias("anchor"), "position", F.when(pre, "вводная часть").otherwise(F.col("section")).alias("section"),
    )


def _first_sentence(text: Column) -> Column:
    return F.pandas_udf(lambda rows: rows.map(lambda x: (sentences(x or "") or [x or ""])[0]), T.StringType())(text)


def government_resolution(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, lines, label, citation, anchor, point, section, form, appendix): a resolution and the acts it approves.

    An act starts at a stamp of approval, whose lines up to the number of the resolution (four at most) are dropped, or
    at the line of an appendix, dropped up to the next empty line. Regulations fall into sections with Roman numbers, forms end in a
    signature; inside all, points are numbered.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines_of(docs).withColumns({"appendix": _number(APPENDIX).cast("int"), "stamp": F.col("line").rlike(STAMP)})
    starts = F.col("appendix").isNotNull() | F.col("stamp")
    rows = rows.withColumn("start", starts).withColumn("s", F.count_if("start").over(_over("doc_id")))
    # Where an act's own lines begin: after its stamp or after its appendix lines.
    ends = F.array(*[F.coalesce(F.lead("line", i).over(w).rlike(STAMP_END), F.lit(False)) for i in range(1, 5)])
    skip = F.when(F.col("stamp"), F.coalesce(F.nullif(F.array_position(ends, True), F.lit(0)), F.lit(5)).cast("int"))
    blank = F.min(F.when(F.col("line") == "", F.col("pos"))).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    content = F.when(F.col("stamp"), F.col("pos") + skip + 1).when(F.col("appendix").isNotNull(), F.coalesce(blank, F.lit(1 << 30)))
    segment = Window.partitionBy("doc_id", "s")
    rows = rows.withColumn("from", content).withColumns({"from": F.coalesce(F.max("from").over(segment), F.lit(0)), "appendix": F.max("appendix").over(segment)})
    rows = rows.filter(F.col("pos") >= F.col("from")).drop("start", "stamp", "from")
    # The title decides what an act is.
    shown = rows.filter("line <> ''").withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "s").orderBy("pos")))
    head = shown.groupBy("doc_id", "s").agg(F.upper(F.array_join(_in_order(F.when(F.col("i") <= TITLE_LINES, F.col("line"))), " ")).alias("title"), F.max(F.when(F.col("i") == 1, F.col("line"))).alias("first"))
    rows = rows.join(head.select("doc_id", "s", F.col("first"), _act(F.col("title"), F.col("first"), F.col("s")).alias("act")), ["doc_id", "s"])
    rows = rows.withColumns({c: F.col("act")[c] for c in ("slug", "kind", "name", "short")}).drop("act")
    app = F.col("appendix").cast("string")
    rows = rows.withColumns({
        "name": F.when(app.isNull(), F.col("name")).otherwise(F.concat(F.lit("Приложение N "), app, F.lit(". "), "name")),
        "short": F.when(app.isNull(), F.col("short")).otherwise(F.concat(F.lit("прил. "), app, F.when(F.col("short") != "", F.concat(F.lit(", "), "short")).otherwise(F.lit("")))),
    })
    # Sections of regulations: a Roman heading after an empty line, up to the next one.
    after_blank = F.coalesce(F.lag("line").over(Window.partitionBy("doc_id", "s").orderBy("pos")) == "", F.lit(True))
    opens = (F.col("kind") == "regulation") & F.col("line").rlike(ROMAN) & after_blank
    rows = rows.withColumn("r", F.count_if(opens).over(_over("doc_id", "s")))
    run = Window.partitionBy("doc_id", "s", "r").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    titled = (F.col("r") > 0) & (F.count_if(F.col("line") == "").over(run) == 0)
    rows = rows.withColumn("titled", titled).filter("line <> ''")
    headings = rows.filter("titled").groupBy("doc_id", "s", "r").agg(F.array_join(_in_order(F.col("line")), " ").alias("heading"))
    # The act's title, before the first section, goes with that section.
    first = F.min(F.when(F.col("r") > 0, F.col("r"))).over(Window.partitionBy("doc_id", "s"))
    rows = rows.withColumn("r", F.when(F.col("r") == 0, F.coalesce(first, F.lit(0))).otherwise(F.col("r"))).filter("not titled").join(headings, ["doc_id", "s", "r"], "left")
    # The tail of a form, then points.
    signed = (F.col("kind") == "form") & F.col("line").rlike(SIGNATURE)
    rows = rows.withColumn("tail", F.count_if(signed).over(_over("doc_id", "s")) > 0)
    rows = rows.withColumn("point", F.when(~F.col("tail"), _number(POINT))).withColumn("p", F.count("point").over(_over("doc_id", "s", "r", "tail")))
    points = F.max("p").over(Window.partitionBy("doc_id", "s", "r", "tail"))
    joins = (F.col("kind") != "form") & (F.col("p") == 0) & (points > 0)
    rows = rows.withColumns({"points": points, "g": F.when(joins, 1).otherwise(F.col("p"))})
    keys = ["doc_id", "prefix", "s", "r", "tail", "g"]
    same = ("slug", "kind", "name", "short", "appendix", "heading", "points")
    blocks = rows.groupBy(*keys).agg(F.min("pos").alias("pos"), _in_order(F.col("line")).alias("lines"), F.min("point").alias("point"), *[F.first(c).alias(c) for c in same])
    preface = F.when(F.col("tail"), "подпись и сноски").when((F.col("kind") == "form") & (F.col("g") == 0) & (F.col("points") > 0), "начало формы (реквизиты)")
    name = F.concat("name", F.when(F.col("heading").isNotNull(), F.concat(F.lit(", раздел "), "heading")).otherwise(F.lit("")))
    ending = lambda before, glue: F.when(F.col("point").isNotNull(), F.concat(F.lit(before), "point")).when(preface.isNotNull(), F.concat(F.lit(glue), preface)).otherwise("")
    where = F.when(F.col("point").isNotNull(), F.concat(F.lit("/p."), "point")).when(F.col("tail"), "/tail").when(preface.isNotNull(), "/head").otherwise("")
    return blocks.select(
        "doc_id", "pos", "lines", F.concat(name, ending(" — п. ", " — ")).alias("label"), F.concat("prefix", F.when(F.col("short") != "", F.concat(F.lit(", "), "short")).otherwise(F.lit("")), ending(", п. ", ", ")).alias("citation"),
        F.concat("slug", F.when(F.col("appendix").isNull(), "").otherwise(F.concat(F.lit("/app."), F.col("appendix").cast("string"))), where).alias("anchor"),
        "point", F.coalesce("heading", F.when(F.col("kind") != "regulation", F.col("name"))).alias("section"), F.when(F.col("kind") == "form", F.col("slug")).alias("form"), "appendix",
    )


def _act(title: Column, first: Column, s: Column) -> Column:
    """(slug, kind, name, short) of an act by its title."""
    subject = F.when(title.contains("ИСПОЛНЕНИЯ ДОГОВОРА"), "договора").otherwise("контракта")
    made = lambda slug, kind, name, short: F.struct(*[x.alias(n) for x, n in zip((slug, kind, name, short), ("slug", "kind", "name", "short"), strict=True)])
    out = F.when(s == 0, made(F.lit("resolution"), F.lit("resolution"), F.lit("Постановление"), F.lit("постановление")))
    for pattern, slug, kind, name, short in ACTS:
        fill = lambda x: F.replace(F.lit(x), F.lit("{subject}"), subject)
        out = out.when(title.rlike(f"(?U){pattern}"), made(F.lit(slug), F.lit(kind), fill(name), fill(short)))
    cut = fn.truncate_words(F.coalesce(first, F.lit("Приложение")), 120)
    return out.otherwise(made(F.lit("annex"), F.lit("rules"), cut, F.lower(cut)))


CHUNKERS = {"civil_code": civil_code, "federal_law": federal_law, "court_review": court_review, "government_resolution": government_resolution}


def blocks(docs: DataFrame, chunker: str) -> DataFrame:
    """The blocks of a registered chunker; an unknown name is an error."""
    if chunker not in CHUNKERS:
        raise ValueError(f"unknown chunker {chunker!r}; known: {sorted((*CHUNKERS, 'generic'))}")
    return CHUNKERS[chunker](docs)


#: How numbered items and lettered sub-items begin.
_ITEMS = (re.compile(r"(\d+)\)\s"), re.compile(r"([а-яё])\)\s"))


def _by_marker(lines: list[str], mark: re.Pattern) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """Lines before the first marked one, and each marked line with those that continue it."""
    marked = [(i, m[1]) for i, m in enumerate(map(mark.match, lines)) if m]
    ends = [i for i, _ in marked[1:]] + [len(lines)]
    return lines[: marked[0][0]] if marked else lines, [(label, lines[i:end]) for (i, label), end in zip(marked, ends, strict=False)]


class _Cutter:
    """Cuts the lines of one block. Paths are (item, sub-item) labels."""

    def __init__(self, target: int, least: int):
        self.target, self.least, self.most = target, least, target * 3 // 2

    def block(self, lines: list[str], items: bool) -> list[tuple[tuple, str]]:
        text = "\n".join(lines)
        if len(text) <= self.most:
            return [((), text)]
        return self.items(lines, [], _ITEMS, ()) if items else self.plain(lines, [], ())

    def plain(self, lines: list[str], head: list[str], path: tuple) -> list[tuple[tuple, str]]:
        """Paragraphs, cut at sentences where needed. Capital titles stay with what follows; a short first line that ends in a colon is repeated."""
        capital = lambda x: x == x.upper() and any(map(str.isalpha, x))
        n = next((i for i, x in enumerate(lines[:-1]) if not capital(x)), len(lines) - 1)
        titles, body = "\n".join(lines[:n]), lines[n:]
        if not titles and len(body) > 1 and body[0].endswith(":") and len(body[0]) <= 0.3 * self.target:
            head, body = [*head, body[0]], body[1:]
        taken = len("\n".join(head))
        room = max(self.target - taken - 1, self.target // 2)
        first = max(room - len(titles) - 1, room // 2) if titles else room
        parts = [p for i, x in enumerate(body) for p in fit(x, room if i else first, self.least, self.most)]
        if titles:
            parts[0] = f"{titles}\n{parts[0]}"
        return [(path, "\n".join([*head, p])) for p in pack(parts, room, "\n", self.least, max(self.most - taken - 1, room))]

    def items(self, lines: list[str], head: list[str], marks: tuple, path: tuple) -> list[tuple[tuple, str]]:
        """Groups of items up to the target after their opening lines; an item over the soft maximum is cut by what it holds."""
        size = lambda x: len("\n".join(x))
        found = next(((opening, each, marks[i + 1 :]) for i, m in enumerate(marks) for opening, each in [_by_marker(lines, m)] if each), None)
        if found is None:
            return self.plain(lines, head, path)
        opening, each, deeper = found
        short = lambda x: x if size(x) <= 0.5 * self.target else []
        lead = [*head, *opening]
        if size(lead) > self.target:
            out, now, again = self.plain(opening, head, path), short(head), short(head)
        else:
            out, now, again = [], lead, short(lead) or short(head)
        group: list[tuple[str, list[str]]] = []

        def close() -> None:
            nonlocal group, now
            if group:
                first, last = group[0][0], group[-1][0]
                out.append(((*path, first if first == last else f"{first}–{last}"), "\n".join([*now, *(x for _, own in group for x in own)])))
                group, now = [], again

        for marker, own in each:
            if group and size(now) + sum(size(x) + 1 for _, x in group) + size(own) + 1 > self.target:
                close()
            if not group and size(now) + size(own) + 1 > self.most:
                out.extend(self.items(own, now, deeper, (*path, marker)))
                now = again
            else:
                group.append((marker, own))
        close()
        return out


def cut_blocks(units: DataFrame, target: int = TARGET, least: int = LEAST, items: bool = True) -> DataFrame:
    """The units with chunk_index, chunk_count, item, subitem and body: blocks over the soft maximum are cut, others stay whole.

    items: cut between numbered and lettered items before sentences (not for reviews of practice)."""
    keep = [f for f in units.schema.fields if f.name != "lines"]
    own = T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("chunk_index", "integer"), ("chunk_count", "integer"), ("item", "string"), ("subitem", "string"), ("body", "string"))]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(target, least)
        for b in slices(batches):
            rows, source = [], []
            for at, lines in enumerate(b.column("lines").to_pylist()):
                cut = cutter.block(lines, items)
                for i, (path, body) in enumerate(cut):
                    source.append(at)
                    rows.append((i, len(cut), *(*path, None, None)[:2], body))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            taken = [b.column(f.name).take(pa.array(source, pa.int64())) for f in keep]
            made = [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*taken, *made], names=[*(f.name for f in keep), *own.names])

    return units.mapInArrow(run, T.StructType(keep + own.fields))


def chunks(docs: DataFrame, chunker: str, target: int = TARGET, least: int = LEAST) -> DataFrame:
    """Chunks of documents (doc_id, text, prefix, source_display, source_kind) with narrow labels, citations and anchors, and the text that is indexed."""
    cut = cut_blocks(blocks(docs, chunker), target, least, items=chunker != "court_review")
    terms = ("п.", "пп.") if chunker == "federal_law" else ("пп.", "пп.")
    part = lambda column, before: F.when(F.col(column).isNull(), "").otherwise(F.concat(F.lit(before), column))
    narrow = F.concat(part("item", f", {terms[0]} "), part("subitem", f", {terms[1]} "))
    named = cut.join(docs.select("doc_id", "source_display", "source_kind"), "doc_id")
    named = named.withColumns({"label": F.concat("label", narrow), "citation": F.concat("citation", narrow), "anchor": F.concat("anchor", part("item", "/item."), part("subitem", "/sub."))})
    return named.withColumn("text", fn.indexed_text(F.col("source_display"), F.col("source_kind"), F.col("label"), F.col("body")))


#: Columns that a chunker's own units have.
UNITS = {"civil_code": "article", "federal_law": "article", "court_review": "position", "government_resolution": "point"}


def unstructured(docs: DataFrame, chunker: str) -> DataFrame:
    """Documents in which the chunker finds none of its units (articles, numbered points, positions with text): they aren't what they claim to be and shouldn't be indexed."""
    found = blocks(docs, chunker)
    good = found.filter(F.col(UNITS[chunker]).isNotNull()).select("doc_id").distinct()
    if chunker == "court_review":
        # A position that is announced must say something.
        lines = lines_of(docs).filter("line <> ''")
        after = F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos"))
        bare = lines.withColumn("after", after).filter(F.col("line").rlike(POSITION_LINE) & (F.col("after").isNull() | F.col("after").rlike(POSITION_LINE)))
        good = good.join(bare.select("doc_id").distinct(), "doc_id", "left_anti")
    return docs.join(good, "doc_id", "left_anti")
