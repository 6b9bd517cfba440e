"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its opening tags, each with the path of elements that leads to it, and its text nodes,
each with its path and a hash. A token's occurrence vector is its count on every page of the host; it is kept as a sum of
count * hash(page), which partitions can add up, so no host's pages ever meet in one task. Tokens with equal vectors form
a class. Every page is parsed once; what later steps need of it is stored.

1. Classes count that are once on each page that has them, on SUPPORT of the host's pages at least and on two or more;
   pages without a tag or text are none. So an error page or two don't undo a host's template, and a host may have several
   classes, one within the other.
2. The containers of these classes nest by their paths, and what lies between them are slots. Free text is what is neither
   a text of such a class nor a link's. The main slot is reached from the top by going into the container that holds MOST
   of the free text, summed over the host's pages, as long as there is one. Headings that stand before it, beside the
   containers that lead to it, belong to it. The pages that have that container are the template's pages.
3. A text of a class is template text if all texts of its element are such, each on every page that has the element, as
   in a footer, whatever the number of pages; not so headings, nor where these texts are more than BULK of the main
   slot's text, for then the pages are copies. A text that stands among free ones, as a notice between paragraphs does,
   is template text if it is on the very pages of the main slot and no accident: a text that a share q of pages has
   anyway (measured on the hosts that don't have it throughout, CHANCE at least) is on all n pages with probability
   q ** n, which must be at most ACCIDENT.
4. Classes of tag tokens that repeat on a page and nest in the main slot are records: RECORD or more tokens of one vector,
   one inside the other, in a container; reader comments and lists of teasers look so, paragraphs don't. They go.
5. A page's text is what is left in the main slot, without blocks of nothing but template text, and without elements
   inside the slot that HTML or a class name marks as menu, form, notice, comments and the like. The names never choose
   the slot.

A page whose main slot holds nothing but template text keeps it. A host with one distinct page has no vectors: of the
main slots of the ROOTS hosts with most pages, and of all hosts taken together, the page takes the deepest that it has.
So does a page that lacks its host's main slot. If there is none, step 2 goes over the page alone. Ties: of containers
of one depth, the last by name.

Defined results: null, empty and markup-only pages have empty text and 0 characters. A null url is a host of its own.
A null page_id is kept. Repeated rows give repeated rows. Extra columns are ignored. An empty table gives an empty result. Texts within a block
are joined as they stand; white space in it becomes one space; a line break element counts as white space. Time and
memory of a page are linear in its length: elements nested deeper than DEPTH share the path of their ancestor there, and
of a container's like siblings those from SIBLINGS on share one.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MOST, RECORD = 0.6, 3
SUPPORT, BULK = 0.5, 0.5
CHANCE, ACCIDENT = 0.03, 1e-6
DEPTH, SIBLINGS, ROOTS = 48, 40, 200
#: Host templates that may be broadcast: rows, and bytes of their lists.
BROADCAST_HOSTS, BROADCAST_BYTES = 20_000, 16_000_000

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][\w:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][\w:-]*)([^>]*)(?:>|\Z)""",
    re.DOTALL,
)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_ORDINAL = re.compile(r":\d+")
# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg textarea title".split())
_ASIDE = frozenset("nav footer aside form button select dialog menu head".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figure figcaption caption address hr ul ol dl".split())
# Words in a class, id or role that mark a part as not the article.
_MARKS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer "
    "form login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)


class Page:
    """What one pass over a page's markup finds.

    tags: counts of the paths of opening tags. nodes: (path, block, link, text) of each text node. In a path, a
    container is followed by its number among like siblings, and a marked element by an exclamation mark.
    """

    def __init__(self, page: str):
        self.tags: dict[str, int] = {}
        self.nodes: list[tuple[str, int, bool, str]] = []
        self._block, self._links, self._open = 0, 0, {}
        # (element, path, children seen by name, place of the paragraph and item that a block ends; -1 for none)
        self._stack: list[tuple[str, str, dict, int, int]] = [("", "", {}, -1, -1)]
        self._articles = 0
        at, end = 0, len(page)
        while at < end:
            m = _TAG.search(page, at)
            self._text(page, at, m.start() if m else end)
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if name not in _INLINE:
                self._block += 1
            if m[1] or m[4]:
                if self._open.get(name):
                    while self._pop() != name:
                        pass
                continue
            attributes = m[3] or m[6] or ""
            if name == "br" and self.nodes and self.nodes[-1][1] == self._block:
                self.nodes.append((*self.nodes[-1][:3], " "))
            if name not in _INLINE:
                _, _, _, paragraph, item = self._stack[-1]
                place = paragraph if paragraph >= 0 else item if name == "li" else -1
                while 0 <= place < len(self._stack):
                    self._pop()
            path = self._path(name, attributes)
            self.tags[path] = self.tags.get(path, 0) + 1
            if name in _RAW:
                m = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                at = m.end() if m else end
            elif name not in _VOID and not attributes.rstrip().endswith("/"):
                self._push(name, path)

    def _text(self, page, a, b):
        if b > a and page[a:b].strip():
            self.nodes.append((self._stack[-1][1], self._block, self._links > 0, entities.unescape(page[a:b])))
        elif b > a and self.nodes and self.nodes[-1][1] == self._block:
            self.nodes.append((*self.nodes[-1][:3], " "))

    def _path(self, name, attributes):
        _, path, children, _, _ = self._stack[-1]
        kinds = [w for x in _CLASS.findall(attributes) for w in re.split(r"[\s_-]+", "".join(x).lower()) if w]
        if len(self._stack) > DEPTH:
            return path
        step = name + ("." + kinds[0].replace("/", "").replace(":", "") if kinds else "")
        if name not in _INLINE and name not in _CONTENT:
            children[step] = children.get(step, 0) + 1
            step += f":{min(children[step], SIBLINGS)}"
        if name in _ASIDE or (name == "header" and not self._articles) or any(w in _MARKS for w in kinds):
            step += "!"
        return f"{path}/{step}" if path else step

    def _push(self, name, path):
        _, _, _, paragraph, item = self._stack[-1]
        here = len(self._stack)
        if name not in _INLINE:
            paragraph, item = (here if name == "p" else -1), (here if name == "li" else -1)
        self._stack.append((name, path, {}, paragraph, item))
        self._open[name] = self._open.get(name, 0) + 1
        self._links += name == "a"
        self._articles += name in ("article", "main")

    def _pop(self):
        name = self._stack.pop()[0]
        self._open[name] -= 1
        self._links -= name == "a"
        self._articles -= name in ("article", "main")
        return name


def _container(path: str) -> bool:
    """Whether the path ends in an element that may hold blocks: only those are numbered."""
    return ":" in path.rpartition("/")[2]


def descend(free: dict[str, int], containers) -> str:
    """The main slot: the deepest container reached by going where MOST of the free text is. free: characters by path."""
    inside: dict[str, int] = {}
    for path, n in free.items():
        while path:
            inside[path] = inside.get(path, 0) + n
            path = path.rpartition("/")[0]
    total = sum(free.values())
    fit = [p for p in containers if total and inside.get(p, 0) >= MOST * total]
    return max(fit, key=lambda p: (p.count("/"), p), default="")


def _heading(path: str, root: str) -> bool:
    """Whether path is a heading beside the containers that lead to root."""
    above, _, last = path.rpartition("/")
    return bool(re.match(r"h[1-6]\b", last)) and (root == above or root.startswith(above + "/"))


def main_text(nodes, root: str, texts=frozenset(), records=()) -> str:
    """Blocks of the nodes (path, block, text, hash) in slot root."""
    first = next((k for k, x in enumerate(nodes) if x[0] == root or x[0].startswith(root + "/")), len(nodes)) if root else 0
    known: dict[str, bool] = {}
    inside = []
    for k, x in enumerate(nodes):
        path = x[0]
        if path not in known:
            below = path[len(root) :] if not root or path == root or path.startswith(root + "/") else None
            shape = _ORDINAL.sub("", path)
            known[path] = below is not None and "!" not in below and not any(shape == r or shape.startswith(r + "/") for r in records)
        if known[path] or (k < first and "!" not in path and _heading(path, root)):
            inside.append(x)
    if texts:
        own = {x[1] for x in inside if x[2].strip() and x[3] not in texts}
        inside = [x for x in inside if x[1] in own] if own else inside  # a block of nothing but template text goes
    out: list[list[str]] = []
    last = None
    for _, block, text, _ in inside:
        if block != last:
            out.append([])
        out[-1].append(text)
        last = block
    return "\n".join(t for t in (" ".join("".join(x).split()) for x in out) if t)


_PARSED = "kind int, host string, page_id long, url string, steps array<string>, once array<string>, node array<int>, block array<int>, free array<boolean>, text array<string>, hash array<long>, token string, mark long, fp long, n long, chars long, df long"


def _parse(batches):
    """Rows _PARSED of kind 0, a page's text nodes, and of an Arrow batch's tokens, added up: 1 pages, 2 tag paths, 3 texts, 4 paths without numbers."""
    import pyarrow as pa
    import xxhash

    names = [x.split()[0] for x in _PARSED.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.string(), *[pa.list_(t) for t in (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64())], pa.string(), *[pa.int64()] * 5]

    def rows(found):
        cols = list(zip(*found, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    for batch in C.trimmed(batches):
        held: dict[tuple, list[int]] = {}
        pages, size = [], 0
        for page_id, url, host, html, key in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "html", "key")), strict=True):
            page = Page(html or "")
            paths = {p: k for k, p in enumerate(dict.fromkeys(x[0] for x in page.nodes))}
            hashes = [xxhash.xxh64_intdigest(f"{p}\0{t.strip()}") - 2**63 if t.strip() else 0 for p, _, _, t in page.nodes]
            once = [p for p, n in page.tags.items() if n == 1 and _container(p)]
            pages.append((0, host, page_id, url, list(paths), once, [paths[x[0]] for x in page.nodes], [x[1] for x in page.nodes], [not x[2] for x in page.nodes], [x[3] for x in page.nodes], hashes, None, None, key if page.tags or page.nodes else None, None, None, None))
            size += len(html or "")
            if not page.tags and not page.nodes:
                continue
            seen: dict[tuple, list[int]] = {(1, host, "", 0): [1, 0]}
            for p, n in page.tags.items():
                seen.setdefault((2, host, p, 0), [0, 0])[0] += n
                seen.setdefault((4, host, _ORDINAL.sub("", p), 0), [0, 0])[0] += n
            for (p, _, link, t), h in zip(page.nodes, hashes, strict=True):
                if h:
                    x = seen.setdefault((3, host, p, h), [0, 0])
                    x[0] += 1
                    x[1] += 0 if link else len(t)
            for name, (n, chars) in seen.items():
                x = held.setdefault(name, [0, 0, 0, 0])
                x[0] = (x[0] + n * key) & (2**62 - 1)
                x[1] += n
                x[2] += chars
                x[3] += 1
            if size > 2_000_000:
                yield rows(pages)
                pages, size = [], 0
        yield rows(pages)
        yield rows([(kind, host, None, None, *[None] * 7, token, mark, *x) for (kind, host, token, mark), x in held.items()])


def templates(ws: C.Workspace, parsed: DataFrame) -> DataFrame:
    """(host, root, texts, records): a host's main slot, template texts and records; host '' stands for all hosts together."""
    tokens = parsed.filter("kind > 0").select("kind", "host", "token", "mark", "fp", "n", "chars", "df")
    # sums wrap in decimal space; taken modulo 2^62
    total = (F.expr("cast(sum(cast(fp as decimal(38,0))) % 4611686018427387904 as bigint)").alias("fp"), *(F.sum(c).alias(c) for c in ("n", "chars", "df")))
    by_host = ws.store(tokens.groupBy("kind", "host", "token", "mark").agg(*total), "tokens")
    # vectors need two different pages; a host with fewer is left to the template of all hosts
    single = ws.store(parsed.filter("kind = 0").groupBy("host").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("high is null or low = high").select("host"), "single")
    mine = by_host.join(single, "host", "left_anti")
    everywhere = by_host.filter("kind < 4").groupBy("kind", "token", "mark").agg(*total).withColumn("host", F.lit(""))

    def steady(rows: DataFrame) -> DataFrame:
        """The tokens with the pages of their host, and whether they are once on each of theirs, SUPPORT of the host's at least."""
        pages = rows.filter("kind = 1").select("host", F.col("n").alias("pages"))
        return rows.filter("kind > 1").join(pages, "host").withColumn("steady", (F.col("n") == F.col("df")) & (F.col("df") >= 2) & (F.col("df") >= SUPPORT * F.col("pages")))

    both, mine = steady(mine.unionByName(everywhere)), steady(mine)

    # a text of a steady class is no free text, be it by accident or not
    free = both.filter("kind = 3 and chars > 0 and not steady").groupBy("host", "token").agg(F.sum("chars").alias("chars"))
    once = both.filter("kind = 2 and steady").select("host", "token", "fp", F.col("df").alias("pages")).filter(F.element_at(F.split("token", "/"), -1).contains(":"))
    # free text of a container is that of all paths below it; a path has at most DEPTH ancestors
    steps = F.split("token", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    inside = free.select("host", F.explode(above).alias("token"), "chars").groupBy("host", "token").agg(F.sum("chars").alias("chars"))
    sums = free.groupBy("host").agg(F.sum("chars").alias("total"))
    roots = once.join(inside, ["host", "token"]).join(sums, "host").filter(F.col("chars") >= MOST * F.col("total"))
    roots = ws.store(roots.groupBy("host").agg(F.max(F.struct(F.size(steps).alias("depth"), "token", "pages", "fp", "chars")).alias("r")).select("host", F.col("r.token").alias("root"), "r.depth", "r.pages", F.col("r.fp").alias("root_fp"), F.col("r.chars").alias("free")), "roots")

    # texts of elements that hold nothing else: steady ones only, each on all pages of the element
    known = roots.filter("host <> ''").select("host", "root", "root_fp", "free")
    texts = mine.filter("kind = 3").join(known, "host").filter(F.col("token").startswith(F.col("root")))
    heading = F.element_at(F.split("token", "/"), -1).rlike(r"^h[1-6]\b")
    own = texts.groupBy("host", "token").agg(F.min("steady").alias("all"), F.min("df").alias("df"), F.max("df").alias("most"), F.sum("chars").alias("chars"), F.first("free").alias("free")).filter(F.col("all") & (F.col("df") == F.col("most")) & ~heading)
    own = own.join(mine.filter("kind = 2").select("host", "token", "df"), ["host", "token", "df"]).select("host", "token", "chars", "free")
    bulk = own.groupBy("host").agg(F.sum("chars").alias("held"), F.first("free").alias("free")).filter(F.col("held") > BULK * (F.col("held") + F.col("free"))).select("host")
    own = texts.filter("steady").join(own.join(bulk, "host", "left_anti").select("host", "token"), ["host", "token"]).select("host", "token", "mark")

    # texts among free ones, on the root's very pages
    each = mine.filter("kind = 3").join(known.select("host", "root_fp"), "host", "left").withColumn("all", F.col("fp").eqNullSafe(F.col("root_fp")))
    corpus = by_host.filter("kind = 1").join(single, "host", "left_anti").agg(F.sum("n")).first()[0] or 0
    shared = each.groupBy("token", "mark").agg(F.sum(F.when(~F.col("all"), F.col("n")).otherwise(0)).alias("some"), F.sum(F.when(F.col("all"), F.col("df")).otherwise(0)).alias("of_all"))
    on_all = texts.filter("fp = root_fp").join(shared, ["token", "mark"], "left").na.fill(0, ["some", "of_all"])
    anyway = (F.col("some") + CHANCE) / (F.lit(corpus) - F.col("of_all") + 1)
    among = on_all.filter(F.pow(F.least(F.greatest(anyway, F.lit(CHANCE)), F.lit(1.0)), F.col("df")) <= ACCIDENT).select("host", "token", "mark")
    texts = ws.store(own.unionByName(among).distinct(), "fixed").groupBy("host").agg(F.collect_list("mark").alias("texts"))

    # records: classes of paths without numbers, more often than pages, RECORD tokens inside the first of them
    repeated = mine.filter("kind = 4 and n > pages").join(roots.filter("host <> ''"), "host").filter(F.startswith("token", F.regexp_replace("root", r":\d+", "")))
    classes = repeated.groupBy("host", "fp").agg(F.min(F.struct(F.length("token"), "token")).alias("first"), F.count("*").alias("tokens"), F.collect_list("token").alias("all"))
    top = F.col("first.token")
    nested = F.size(F.filter("all", lambda x: F.startswith(x, F.concat(top, F.lit("/"))))) >= RECORD - 1
    last = F.regexp_extract(top, r"([a-z0-9]+)[^/]*$", 1)
    records = classes.filter((F.col("tokens") >= RECORD) & nested & ~last.isin(sorted(_CONTENT - {"li"} | _INLINE))).groupBy("host").agg(F.collect_list(top).alias("records"))
    return roots.join(texts, "host", "left").join(records, "host", "left").select("host", "root", "depth", "pages", "texts", "records")


def _extract(batches, elsewhere):
    import pyarrow as pa

    for batch in C.trimmed(batches):
        known: dict[str, tuple] = {}
        out = []
        cols = ("host", "steps", "once", "node", "block", "free", "text", "hash", "root", "texts", "records")
        for host, steps, once, node, block, free, text, marks, root, texts, records in zip(*(batch.column(c).to_pylist() for c in cols), strict=True):
            if host not in known:
                known[host] = frozenset(texts or ()), tuple(records or ())
            nodes = [(steps[p], b, t, h) for p, b, t, h in zip(node, block, text, marks, strict=True)]
            if root and root in once:
                out.append(main_text(nodes, root, *known[host]))
                continue
            root = next((r for r in elsewhere if r in once), None)
            if root is None:
                own: dict[str, int] = {}
                for x, f in zip(nodes, free, strict=True):
                    own[x[0]] = own.get(x[0], 0) + (len(x[2].strip()) if f else 0)
                root = descend(own, once)
            out.append(main_text(nodes, root))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages(page_id, url, html)."""
    ws = C.Workspace(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("?"))
    rows = pages.select(F.col("page_id").cast("long"), "url", F.when(host == "", "?").otherwise(host).alias("host"), "html", F.shiftrightunsigned(F.xxhash64("html"), 3).alias("key"))
    parsed = ws.store(rows.mapInArrow(_parse, _PARSED), "parsed")
    found = ws.store(templates(ws, parsed), "templates")
    common = found.groupBy("root").agg(F.max("depth").alias("depth"), F.sum("pages").alias("pages")).orderBy(F.desc("pages"), "root").limit(ROOTS)
    elsewhere = [r.root for r in common.orderBy(F.desc("depth"), F.desc("pages"), "root").collect()]  # ROOTS rows
    own = found.filter("host <> ''")
    n, size = own.agg(F.count("*"), F.sum(F.coalesce(F.size("texts"), F.lit(0)) * 8 + F.coalesce(F.octet_length(F.array_join("records", "")), F.lit(0)) + F.octet_length("root"))).first()
    nodes = parsed.filter("kind = 0").select("page_id", "url", "host", "steps", "once", "node", "block", "free", "text", "hash")
    small = n <= BROADCAST_HOSTS and (size or 0) <= BROADCAST_BYTES
    joined = nodes.join((F.broadcast(own) if small else own).drop("depth", "pages"), "host", "left")
    return joined.mapInArrow(lambda it: _extract(it, elsewhere), "page_id long, url string, text string, n_chars long")
