"""Main text of web pages by the repeats of their host.

A page is read into blocks of text, each with what its tags say: article, furniture (navigation, headers, footers, sidebars,
forms, adverts, notices, comments) or neither. The token streams of a host's pages, all blocks of them, are concatenated and
their suffixes sorted. Suffixes whose first ``REPEAT`` tokens stand in several distinct contents of the host cover these
tokens, and covered runs go:

- outside of articles where a repeat stands in two contents and a share of ``SHARE`` of the host's;
- inside of articles only where it stands all over the site, that is in ``SITE`` contents and the share ``SITE_SHARE`` of the
  host's. A passage that some articles share is text; and an article of which more than half would go is a copy of others,
  and stays whole.

What the suffixes leave is the article's unique runs, and on pages without an article, or with less of it than of other text,
the other unique runs as well. Furniture goes also where nothing repeats it: hosts of one page have menus too.

Copies of a page have one content, so they don't cover each other. A large host is dealt out in shards of pages by their
contents. Each shard sorts its own suffixes and names the classes of equal starts that reach the share in it by a digest: what
reaches the share of the host does so in one of its shards at least. The digests that any shard names are counted over all
contents of the host, and its pages are covered by those that reach the share. No task ever holds more than a shard.

Defined results: null html, and a page without text, give the empty text. Pages without a host in their url count as one
host's. Repeated rows give repeated results (and count as one content); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkite.llm.common import bounded, written

#: Tokens that must repeat on another page.
REPEAT = 10
#: Share of a host's distinct contents that a repeat must stand in: a quotation or an edited copy is no boilerplate.
SHARE = 0.1
#: The same inside of articles, and how many contents.
SITE_SHARE = 0.5
SITE = 5
#: Characters of html in a shard of a host, about.
SHARD = 2_000_000
#: Rows of one content beyond which its copies are dealt over the shards of their host.
COPIES = 1000
LOOSE, ARTICLE, FURNITURE = 0, 1, 2

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "caption", "body", "html"}
FURNISHED = frozenset("head nav footer aside form menu dialog button select".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in a class or id that mark furniture outside of articles only: in them, they name parts of the text.
IN_ARTICLES = frozenset("header legal login masthead navigation search teaser disclaimer copyright".split())
#: Words that join others to names of furniture, and words that mark it in articles only where nothing else is named.
JOINED = frozenset("area bar block body bottom box button buttons container content form icon icons inline inner item items left link links list media post posts reader readers right section site slot thread top unit user users widget wrap wrapper".split())
DOUBTFUL = frozenset("banner menu notice overlay promotion related replies reply share social sponsor".split())
#: Words in a class or id that mark furniture.
NAMED = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " copyright disclaimer disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification"
    " overlay pager pagination popup promo promoted promotion related replies reply search share sharing sidebar signup social sponsor"
    " sponsored subscribe subscription teaser toolbar widget".split()
)

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)""", re.S)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    """A header inside an article is part of it, an article inside another one is a reader's comment.

    Inside articles a name marks furniture as a whole only (``share-buttons``, not ``notice-board``), a doubtful one where the
    element has no other name (``social``, not ``social science``); an element within a line only by one undoubted name (``ad``).
    """
    if tag in FURNISHED or tag == ("article" if in_article else "header"):
        return True
    if not attributes or tag in ("body", "html"):
        return False
    named = NAMED - IN_ARTICLES if in_article else NAMED
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() == "role":
            if value in ROLES:
                return True
        elif not in_article:
            if named.intersection(re.split(r"[^a-z0-9]+", value)):
                return True
        else:
            names = [re.split(r"[^a-z0-9]+", token) for token in value.split()]
            whole = [bool(named.intersection(n)) and all(x in named or x in JOINED for x in n if x) for n in names]
            sure = [w and (n[0] not in DOUBTFUL if len(n) == 1 else tag in BLOCKS) for w, n in zip(whole, names)]
            if any(sure) or (tag in BLOCKS and whole and all(whole)):
                return True
    return False


def blocks_of(html: str) -> tuple[list[str], list[int]]:
    """The blocks of text of a page, and of each whether it is in an article, in furniture or in neither. The work grows with the
    page's length, however deep its tags are nested."""
    blocks: list[str] = []
    kinds: list[int] = []
    open_tags: list[tuple[str, int]] = []  # tag, and 1 for furniture, 2 for an article
    count: dict[str, int] = {}
    paragraphs: list[int] = []  # places of open <p>, and of open tags that one behind them isn't closed through
    walls: list[int] = []
    hidden = inside = 0
    shown: list[str] = []
    furnished: list[str] = []
    at = 0

    def text(raw: str) -> None:
        if raw:
            (furnished if hidden else shown).append(unescape(raw) if "&" in raw else raw)

    def flush(parts: list[str], kind: int) -> None:
        if parts:
            found = " ".join("".join(parts).split())
            parts.clear()
            if found:
                blocks.append(found)
                kinds.append(kind)

    def end_block() -> None:
        flush(shown, ARTICLE if inside else LOOSE)
        flush(furnished, FURNITURE)

    def pop(n: int) -> None:
        nonlocal hidden, inside
        for tag, kind in open_tags[n:]:
            hidden -= kind == 1
            inside -= kind == 2
            count[tag] -= 1
        del open_tags[n:]
        for places in (paragraphs, walls):
            while places and places[-1] >= n:
                places.pop()
        if not hidden:
            flush(furnished, FURNITURE)

    while m := TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            end_block()
        if m[1]:
            if count.get(tag):
                n = len(open_tags) - 1
                while open_tags[n][0] != tag:
                    n -= 1
                pop(n)
        elif tag in RAW:
            end = RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            if tag in CLOSES_P and paragraphs and not (walls and walls[-1] > paragraphs[-1]):
                pop(paragraphs[-1])
            if tag in ("article", "main"):
                kind = 1 if is_furniture(tag, m[3], inside > 0 and count.get("article", 0) > 0) else 2
            else:
                kind = int(is_furniture(tag, m[3], inside > 0))
            if tag == "p":
                paragraphs.append(len(open_tags))
            elif tag in ("div", "article", "td"):
                walls.append(len(open_tags))
            open_tags.append((tag, kind))
            count[tag] = count.get(tag, 0) + 1
            hidden += kind == 1
            inside += kind == 2
    text(html[at:])
    end_block()
    return blocks, kinds


def sorted_starts(tokens, left, width: int = REPEAT):
    """Of concatenated streams of tokens (numbers, and how many of the stream are left from here on): places of the suffixes of
    at least ``width`` tokens, by the order of their first ``width`` tokens, and their classes; equal classes have equal starts, and stand in the order of their places."""
    import numpy as np

    rank, known, order = tokens, 1, np.argsort(tokens, kind="stable")
    while known < width:  # prefix doubling: ranks of the first 2 * known tokens from two ranks of the first known
        step = min(known, width - known)
        other = np.zeros(len(rank), "i8")
        other[: max(0, len(rank) - step)] = rank[step:] + 1
        both = rank * (int(other.max(initial=0)) + 1) + other
        order = np.argsort(both, kind="stable" if known + step == width else None)
        change = np.r_[False, both[order][1:] != both[order][:-1]][: len(order)]
        rank = np.empty(len(order), "i8")
        rank[order] = np.cumsum(change)
        known += step
    use = order[left[order] >= width]
    return use, rank[use]


class Streams:
    """The token streams of pages' blocks, as numbers."""

    def __init__(self, pages: list[list[str]]):
        import numpy as np

        vocabulary: dict[str, int] = {}
        self.words = [[b.split(" ") for b in blocks] for blocks in pages]
        self.tokens = np.array([vocabulary.setdefault(t, len(vocabulary)) for blocks in self.words for b in blocks for t in b], "i8")
        self.sizes = np.array([sum(map(len, blocks)) for blocks in self.words], "i8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.stream = np.repeat(np.arange(len(pages)), self.sizes)
        self.left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(len(self.tokens))
        self.vocabulary = list(vocabulary)

    def digests(self, width: int):
        """A 64-bit hash of the first ``width`` tokens of every suffix that has as many."""
        import numpy as np
        from xxhash import xxh64_intdigest

        own = np.array([xxh64_intdigest(t) for t in self.vocabulary], "u8")[self.tokens] if len(self.tokens) else np.zeros(0, "u8")
        out = np.zeros(len(own), "u8")
        with np.errstate(over="ignore"):
            for i in range(min(width, len(own))):
                out *= np.uint64(0x9E3779B97F4A7C15)
                out[: len(own) - i] += own[i:]
            out ^= out >> np.uint64(29)
        return out.view("i8")

    def covered(self, places, width: int):
        """Which tokens the starts at ``places`` cover."""
        import numpy as np

        edge = np.zeros(len(self.tokens) + 1, "i8")
        np.add.at(edge, places, 1)
        np.add.at(edge, np.minimum(places + width, len(self.tokens)), -1)
        return np.cumsum(edge)[:-1] > 0

    def text(self, page: int, kinds, repeated, site) -> str:
        """The main text of a page: ``repeated`` and ``site`` tell of its tokens whether a repeat, or one of the whole site, covers them."""
        lo = int(self.starts[page])
        found: dict[int, list[tuple[int, list[str], int]]] = {LOOSE: [], ARTICLE: []}
        for n, (words, kind) in enumerate(zip(self.words[page], kinds)):
            hi = lo + len(words)
            if kind != FURNITURE:
                cover = (site if kind == ARTICLE else repeated)[lo:hi]
                left = [w for w, c in zip(words, cover.tolist()) if not c] if cover.any() else words
                found[kind].append((n, left, len(words)))
            lo = hi
        if 2 * sum(len(left) for _, left, _ in found[ARTICLE]) < sum(k for *_, k in found[ARTICLE]):
            article = [(n, words) for (n, _, _), words in zip(found[ARTICLE], (w for w, k in zip(self.words[page], kinds) if k == ARTICLE))]
        else:
            article = [(n, left) for n, left, _ in found[ARTICLE]]
        loose = [(n, left) for n, left, _ in found[LOOSE]]
        if sum(len(w) for _, w in loose) <= sum(len(w) for _, w in article):
            loose = []
        return "\n".join(" ".join(words) for _, words in sorted(article + loose) if words)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def packed(blocks: list[str], kinds: list[int]) -> bytes:
    """Blocks with their kinds, compressed: a line for each, as blocks have no line breaks."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress("\n".join(f"{k}{b}" for k, b in zip(kinds, blocks)).encode("utf-8", "surrogatepass"))


def unpacked(blob: bytes) -> tuple[list[str], list[int]]:
    import zstandard

    lines = zstandard.ZstdDecompressor().decompress(blob).decode("utf-8", "surrogatepass").split("\n")
    return [x[1:] for x in lines if x], [int(x[0]) for x in lines if x]


def dealt(pages: DataFrame, shard: int, copies: int) -> DataFrame:
    """(key, url, html) with ``host shards shard counted content``: the shard of its host's where a page's suffixes are sorted, and whether it counts
    there. Equal contents are in one shard, but for those with many copies, which count in just one."""
    named = pages.withColumn("host", host_of(F.col("url")))
    content = F.xxhash64("host", "html")
    large = named.groupBy("host").agg(F.sum(F.length("html")).alias("n")).filter(F.col("n") > shard)
    # both are small, and written so that a host or content with very many pages isn't joined in one task
    large = written(large.select(F.col("host").alias("large"), F.ceil(F.col("n") / shard).cast("int").alias("of")), "hosts")
    hot = named.groupBy(content.alias("hot")).agg(F.count("*").alias("n"), F.min("key").alias("least")).filter(F.col("n") > copies)
    hot = written(hot.select("hot", "least"), "copies")
    rows = named.withColumn("content", content).join(large, F.col("host") == F.col("large"), "left").join(hot, F.col("content") == F.col("hot"), "left")
    home = F.pmod("content", "shards").cast("int")
    rows = rows.withColumn("shards", F.coalesce("of", F.lit(1)))
    # the copy with the least key goes home, so that the content counts there whatever the others' keys
    stays = F.col("hot").isNull() | F.col("key").eqNullSafe(F.col("least"))
    spread = F.when(stays, home).otherwise(F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    return rows.select("key", "url", "html", "host", "shards", spread.alias("shard"), (spread == home).alias("counted"), "content")


def parsed(pages: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``dealt`` with ``packed`` blocks in place of html, so that markup isn't shuffled."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            blobs = pa.array([packed(*blocks_of(h)) for h in b.column("html").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [blobs], names=[*names, "blob"])

    names = ["key", "url", "host", "shards", "shard", "counted", "content"]
    return bounded(pages).mapInArrow(run, f"key {kinds['key']}, url {kinds['url']}, host string, shards int, shard int, counted boolean, content bigint, blob binary")


def indexed(pages: DataFrame, width: int, kinds: dict[str, str]) -> DataFrame:
    """Shards of ``parsed`` as rows ``key url host text first blob digests contents``: the text of pages of hosts of one shard; of others the
    blocks, with a mark for the first row of each content, and in one row (without blocks) the shard's starts that reach the
    share."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema(
            [table.schema.field("key"), table.schema.field("url"), ("host", pa.string()), ("text", pa.string()), ("first", pa.bool_())]
            + [("blob", pa.binary()), ("digests", pa.list_(pa.int64())), ("contents", pa.int64())]
        )
        alone = table.column("shards")[0].as_py() == 1
        host = table.column("host")[0].as_py()
        at: dict[int, int] = {}
        row = [at.setdefault(c, len(at)) for c in table.column("content").to_pylist()]
        blobs = dict(zip(row, table.column("blob").to_pylist()))
        pages = [unpacked(blobs[i]) for i in range(len(at))]
        counted = np.zeros(len(at), bool)
        np.logical_or.at(counted, row, table.column("counted").to_numpy())
        streams = Streams([b for b, _ in pages])
        place, rank = sorted_starts(streams.tokens, streams.left, width)
        change = np.r_[True, rank[1:] != rank[:-1]][: len(rank)]
        group = np.cumsum(change) - 1
        # distinct contents of each class, whose suffixes stand in the order of their streams
        stream = streams.stream[place]
        once = (change | np.r_[True, stream[1:] != stream[:-1]][: len(stream)]) & counted[stream]
        n = np.bincount(group[once], minlength=int(change.sum()))
        contents = int(counted.sum())
        columns = {name: [None] * len(row) for name in schema.names[3:]}
        if alone:
            often, all_over = shares(n, contents)
            repeated, site = streams.covered(place[often[group]], width), streams.covered(place[all_over[group]], width)
            texts = [streams.text(i, k, repeated, site) for i, (_, k) in enumerate(pages)]
            columns["text"] = [texts[i] for i in row]
        else:
            new = set(np.flatnonzero(counted).tolist())
            for i, k in enumerate(row):
                columns["first"][i] = k in new
                new.discard(k)
            columns["blob"] = [blobs[i] for i in row]
        out = pa.table([table.column("key"), table.column("url"), pa.array([host] * len(row), pa.string()), *(pa.array(columns[c], schema.field(c).type) for c in schema.names[3:])], schema=schema)
        if not alone:
            named = streams.digests(width)[place[np.flatnonzero(change)[n >= SHARE * max(1, contents)]]]
            stats = [[None], [None], [host], [None], [None], [None], [named.tolist()], [contents]]
            out = pa.concat_tables([out, pa.table([pa.array(v, f.type) for v, f in zip(stats, schema)], schema=schema)])
        return out

    schema = f"key {kinds['key']}, url {kinds['url']}, host string, text string, first boolean, blob binary, digests array<bigint>, contents bigint"
    return bounded(pages).groupBy("host", "shard").applyInArrow(run, schema)


def shares(n, contents):
    """Whether starts in ``n`` of so many contents are repeats, and whether they are all over the site. Numbers or columns."""
    return (n >= 2) & (n >= SHARE * contents), (n >= SITE) & (n >= SITE_SHARE * contents)


def places_of(streams: Streams, digest, width: int, page: int, wanted):
    """Places of a page whose starts have one of the digests ``wanted`` (an Arrow list, or null)."""
    import numpy as np

    if not wanted.is_valid or not len(wanted):
        return np.zeros(0, "i8")
    lo = int(streams.starts[page])
    own = slice(lo, lo + int(streams.sizes[page]))
    return lo + np.flatnonzero((streams.left[own] >= width) & np.isin(digest[own], wanted.values.to_numpy()))


def site_digests(rows: DataFrame, width: int) -> DataFrame:
    """(of, repeated, site): of hosts of several shards in ``indexed`` the digests of starts that reach the shares, counted over all
    contents. A shard names at most a page's tokens over ``SHARE`` of them."""
    stats = rows.filter("digests is not null")
    named = written(stats.select("host", F.explode("digests").alias("d")).groupBy(F.col("host").alias("of")).agg(F.collect_set("d").alias("named")), "named")
    each = rows.filter("first").select("host", "blob").join(named, F.col("host") == F.col("of")).select("host", "blob", "named")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            streams = Streams([unpacked(x)[0] for x in b.column(1).to_pylist()])
            digest, found = streams.digests(width), {}
            for i, (host, wanted) in enumerate(zip(b.column(0).to_pylist(), b.column(2))):
                found.setdefault(host, []).append(np.unique(digest[places_of(streams, digest, width, i, wanted)]))
            for host, digests in found.items():
                values, n = np.unique(np.concatenate(digests), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(values), pa.string()), pa.array(values), pa.array(n.astype("i8"))], names=["host", "digest", "n"])

    counts = bounded(each).mapInArrow(run, "host string, digest bigint, n bigint").groupBy("host", "digest").agg(F.sum("n").alias("n"))
    contents = stats.groupBy(F.col("host").alias("h")).agg(F.sum("contents").alias("contents"))
    often, all_over = shares(F.col("n"), F.col("contents"))
    reached = counts.join(contents, F.col("host") == F.col("h")).filter(often)
    return reached.groupBy(F.col("host").alias("of")).agg(F.collect_list("digest").alias("repeated"), F.collect_list(F.when(all_over, F.col("digest"))).alias("site"))


def covered_texts(pages: DataFrame, width: int, kinds: dict[str, str]) -> DataFrame:
    """(key, url, blob, repeated, site) to (key, url, text)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            pages = [unpacked(x) for x in b.column("blob").to_pylist()]
            streams = Streams([blocks for blocks, _ in pages])
            digest, covers = streams.digests(width), []
            for name in ("repeated", "site"):
                places = [places_of(streams, digest, width, i, wanted) for i, wanted in enumerate(b.column(name))]
                covers.append(streams.covered(np.concatenate(places), width))
            texts = [streams.text(i, k, *covers) for i, (_, k) in enumerate(pages)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), pa.array(texts, pa.string())], names=["key", "url", "text"])

    return bounded(pages).mapInArrow(run, f"key {kinds['key']}, url {kinds['url']}, text string")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", *, width: int = REPEAT, shard: int = SHARD, copies: int = COPIES) -> DataFrame:
    """``key url text`` of each page."""
    named = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kinds = dict(named.dtypes)
    rows = written(indexed(parsed(dealt(named, shard, copies), kinds), width, kinds), "pages")
    texts = rows.filter("text is not null").select("key", "url", "text")
    several = rows.filter("blob is not null")
    sites = written(site_digests(rows, width), "sites")
    more = several.join(sites, F.col("host") == F.col("of"), "left").select("key", "url", "blob", "repeated", "site")
    out = texts.unionByName(covered_texts(more, width, kinds))
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text")


def op9_main_text(spark, sf_dir: str) -> DataFrame:
    from labelkite.session import table

    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
