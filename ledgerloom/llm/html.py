"""Main text of web pages by consensus host paths.

1. Each page's containers (elements that hold blocks of text) are scored: by their own running text outside boilerplate,
   less link text. From the best one the choice climbs to the lowest element that holds all running text that isn't boilerplate
   (within article and main if the best one is there, so text beside them stays out). That element's path (tags with their
   generalised classes, from body down) is the page's vote, as a digest of fixed length.
2. Spark sums votes by host and path; each host's winning path is the one with the most pages, then the largest score,
   then the smallest digest. Sums have map-side combination, so one host with a third of the pages is no hot key.
3. Each page is extracted again along its host's winning path; a page without such an element by its own choice.

Winning paths are broadcast while their hosts and digests have HOSTS_BYTES at most, joined by host beyond.

Within the main element, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are left out, by element or by name (an article's own header is text; a wrapper that holds the article stays, whatever its name; so does a passage of the article
that is named like furniture of a page but has no links or form fields to show for it). Inline elements count too, by name.
Character references are decoded, white space within a block becomes one space, blocks are joined by one newline.

The host is what a url names before its path, with or without a scheme. A page whose url is null or names none has no
host: it doesn't vote and is extracted by its own best container. Null or empty html gives an empty text; an empty table an
empty result. Ties of score within a page go to the element that comes first. Each input row gives one row, repeated rows too.
Very long and very deep pages are handled whole, in time and memory proportional to their length. Only id, url and
html are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, scan, table

#: Bytes of hosts and digests that are broadcast at most.
HOSTS_BYTES = 4 << 20
#: Entries of a task's memo of keys and of one of names; at so many it begins anew.
MEMO_MOST = 8192

# Elements by their roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg object select".split())
FIELDS = frozenset("input textarea select button".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split(),
)
CONTAINERS = frozenset("article main section div td body blockquote center".split())
OUTSIDE = frozenset("nav header footer aside form button menu dialog head label".split())
#: An opening tag that closes an open element of the same row.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of class, id or role that mark what is not main text.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social comment comments commentlist respond disqus reply replies reviews discussion cookie cookies consent gdpr notice notification popup modal newsletter subscribe signup login search pagination pager toolbar skip".split(),
)
#: Those of them that name running text; the others need links or form fields to show that they are furniture, within an article
#: or on a paragraph, heading or inline element.
SPOKEN = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo comment comments commentlist respond disqus reply replies reviews discussion cookie cookies consent gdpr notice notification popup modal newsletter subscribe".split(),
)
#: Words that name a section of an article as well: furniture only with several entries alike, or form fields.
LISTED = frozenset("reply replies reviews discussion".split())
#: What readers say; several entries alike, or form fields, show that a longer name means just that.
REPLIES = frozenset("comment comments commentlist disqus reply replies reviews discussion".split())
PASSAGES = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote figcaption pre".split())
#: Parts that may follow such a word in a longer name, and parts whose names tell of a state or of the content instead.
FURNITURE = frozenset(
    "area bar body block bottom box button buttons col column container form group holder inner item items left link links list outer panel right section slot thread threads top unit wrap wrapper".split(),
)
STATES = frozenset("content has have hide is layout no non not off on with without".split())
PARTS = re.compile(r"[_-]+")

# quotes delimit a value only right after the equals sign; within an unquoted one they are characters
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"'][^\s<>]*)?|[^<>=])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
NAMING = re.compile("class|id|role|hidden", re.I)
BLANKS = re.compile(r"\s+")
DIGITS = re.compile(r"[0-9]+")
HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:(?=//))?(?://)?(?:[^/?#@]*@)?([^/?#:@\s]+)"


class Node:
    __slots__ = ("forms", "inline", "key", "links", "listed", "named", "outside", "pieces", "replies", "spoken", "step", "tag", "text", "up")

    def __init__(self, tag: str, step: str, up: Node | None, outside: bool, named: int = 0, spoken: bool = False, inline: bool = False) -> None:
        self.tag, self.step, self.up, self.outside = tag, step, up, outside
        self.key = key_of(up.key if up else "", step)
        self.named, self.spoken = named, spoken  # as boilerplate, see named_as()
        self.inline, self.forms, self.listed, self.replies = inline, False, False, False
        self.text = 0.0  # characters of own running text less links; then of blocks inside
        self.links = 0  # characters of own links
        self.pieces: list = []  # in page order: strings, BREAK, or nodes

    @property
    def path(self) -> str:
        """The steps from the page down, written out; what is compared are keys, which are as long for deep elements."""
        steps, n = [], self
        while n is not None:
            if n.step:
                steps.append(n.step)
            n = n.up
        return "".join(f"/{x}" for x in reversed(steps))


_KEYS: dict[tuple[str, str], str] = {}  # pages of a host share their paths; it travels with the functions, empty
_NAMES: dict[str, tuple[tuple[int, str], ...]] = {}


def key_of(key: str, step: str) -> str:
    if not step:
        return key
    if (found := _KEYS.get((key, step))) is None:
        if len(_KEYS) >= MEMO_MOST:
            _KEYS.clear()
        found = _KEYS[key, step] = hashlib.blake2b(f"{key}/{step}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
    return found


def key_of_path(path: str) -> str:
    key = ""
    for step in path.split("/")[1:]:
        key = key_of(key, step)
    return key


BREAK = None


def words_named(label: str) -> tuple[tuple[int, str], ...]:
    """(2, word) for each name in a label that is a word of boilerplate, (1, word) for each longer name that ends in one."""
    if (known := _NAMES.get(label)) is not None:
        return known
    if len(_NAMES) >= MEMO_MOST:
        _NAMES.clear()
    found = []
    for name in label.lower().split():
        parts = PARTS.split(name.strip("_-"))
        if name in BOILERPLATE:
            found.append((2, name))
        elif STATES.isdisjoint(parts):
            while len(parts) > 1 and (parts[-1] in FURNITURE or parts[-1].isdigit()):
                parts.pop()
            if parts[-1] in BOILERPLATE:
                found.append((1, parts[-1]))
    _NAMES[label] = tuple(found)
    return _NAMES[label]


def named_as(label: str) -> int:
    """2 if one of the names in a label is a word of boilerplate, 1 if a longer name ends in one, 0 otherwise."""
    return max((n for n, _ in words_named(label)), default=0)


def unsupported(nodes: list[Node]) -> None:
    """Takes their names from elements that are named like furniture, where running text belongs, without a third of their
    text in links and without form fields."""
    links, plain, forms, article = {}, {}, {}, {}
    for n in nodes:
        article[id(n)] = n.up is not None and (article[id(n.up)] or n.up.tag in ("article", "main"))
        links[id(n)], plain[id(n)], forms[id(n)] = n.links, sum(len(p) for p in n.pieces if isinstance(p, str)) - n.links, n.forms
    for n in reversed(nodes):
        if n.up is not None:
            for of in (links, plain, forms):
                of[id(n.up)] += of[id(n)]
    entries = set()  # elements that hold two alike, anywhere inside
    for n in reversed(nodes):
        alike = Counter(p.step for p in n.pieces if isinstance(p, Node) and p.tag in ("li", "div", "article", "section", "dd"))
        if any(c > 1 for c in alike.values()) or id(n) in entries:
            entries.add(id(n))
            if n.up is not None:
                entries.add(id(n.up))
    for n in nodes:
        k = id(n)
        if n.listed and k not in entries and not forms[k]:
            n.named = 0
        elif n.named and n.replies and (k in entries or forms[k]):
            n.named = 2
        elif n.named and not n.spoken and (article[k] or n.tag in PASSAGES or n.inline) and not forms[k] and 2 * links[k] < plain[k]:
            n.named = 0


def settle(root: Node) -> None:
    """Puts outside what is named as boilerplate, with all that it holds. A longer name counts for less: such an element
    stays if it holds an article while none is elsewhere, or half of the page's running text. One that is named by the
    word itself stays only if it holds the largest article while none is elsewhere."""
    nodes = nodes_of(root)
    if not any(n.named for n in nodes):
        return
    unsupported(nodes)
    size, weak, best, inside = {}, dict.fromkeys(map(id, nodes), 0.0), dict.fromkeys(map(id, nodes), 0.0), {}
    for n in nodes:
        inside[id(n)] = n.up is not None and (inside[id(n.up)] or n.up.named and n.up.tag not in ("article", "main"))
        size[id(n)] = 0.0 if n.outside else max(0.0, n.text)
    elsewhere = False
    for n in reversed(nodes):
        all_of, k = size[id(n)], id(n)
        weak[k] += 0.0 if n.outside else max(0.0, n.text)
        if n.tag in ("article", "main") and not n.named and not n.outside and all_of > 0:
            best[k] = max(best[k], all_of)
            elsewhere |= not inside[k]
        if n.up is not None:
            size[id(n.up)] += all_of
            weak[id(n.up)] += 0.0 if n.named == 2 else weak[k]
            best[id(n.up)] = max(best[id(n.up)], best[k])
    page, most = weak[id(root)], best[id(root)]
    for n in nodes:
        k = id(n)
        holds = not elsewhere and best[k] > 0
        stays = not n.named or n.tag in ("html", "body", "article", "main") or (
            holds and best[k] == most if n.named == 2 else holds or weak[k] > 0 and 2 * weak[k] >= page
        )
        n.outside = n.outside or not stays or n.up is not None and n.up.outside


def parse(page: str, by_names: bool = True) -> Node:
    """The tree of a page. Unknown closing tags are skipped; a closing tag closes what is open inside its element; a
    block closes an open paragraph. by_names: what is named as boilerplate is outside."""
    root = top = Node("html", "", None, False)
    stack, at, links = [root], 0, 0
    opened: Counter = Counter()  # elements on the stack, by tag
    inline: Counter = Counter()  # inline elements within the innermost inline node, by tag
    unclosed: set[str] = set()

    def leave() -> Node:
        gone = stack.pop()
        opened[gone.tag] -= 1
        return gone

    while True:
        m = TOKEN.search(page, at)
        data = page[at : m.start() if m else len(page)]
        if data:
            top.pieces.append(data)
            if not data.isspace():
                top.links += len(data) if links else 0
                if not top.outside:
                    top.text += -len(data) if links else len(data)
        if not m:
            if by_names:
                settle(root)
            return root
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):  # closing
            if tag == "a":
                links = max(0, links - 1)
            if tag == "br":
                top.pieces.append(" ")
            elif opened[tag] and (tag in BLOCKS or tag in OUTSIDE):
                while stack[-1].tag != tag:
                    leave()
                leave()
                top, links = stack[-1], 0
            elif top.inline and tag == top.tag:
                if inline[tag]:
                    inline[tag] -= 1
                else:
                    leave()
                    top = stack[-1]
            continue
        if tag in FIELDS:
            top.forms = True
        if tag in RAW and tag not in VOID:
            end = None if tag in unclosed else END[tag].search(page, at)
            if end is None:
                unclosed.add(tag)
            at = end.end() if end else (len(page) if tag in ("script", "style") else at)
            continue
        if tag == "br" or tag == "wbr" or tag in VOID and tag != "hr":
            top.pieces.append(" " if tag != "wbr" else "")
            continue
        names = {a[0].lower(): a[1] or a[2] or a[3] for a in reversed(ATTRIBUTE.findall(m.group(3)))} if m.group(3) and NAMING.search(m.group(3)) else {}
        label = f"{names.get('class', '')} {names.get('id', '')} {names.get('role', '')}".strip()
        words = words_named(label) if label and tag not in ("html", "body") else ()
        named, spoken = max((n for n, _ in words), default=0), any(w in SPOKEN for _, w in words)
        listed, replies = bool(words) and all(w in LISTED for _, w in words), bool(words) and all(w in REPLIES for _, w in words)
        if tag == "a":
            links += 1
        if tag not in BLOCKS and tag not in OUTSIDE:
            if top.inline and tag == top.tag:
                inline[tag] += 1
            elif named or "hidden" in names:
                top = Node(tag, tag, top, top.outside or "hidden" in names, named, spoken, True)
                top.listed, top.replies = listed, replies
                stack[-1].pieces.append(top)
                stack.append(top)
                opened[tag] += 1
                inline.clear()
            continue
        links = 0
        closes = CLOSES.get(tag, ())
        if tag in BLOCKS and stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            leave()
        elif closes and stack[-1].tag == "p" and len(stack) > 1 and stack[-2].tag in closes:
            leave()
        while closes and len(stack) > 1 and stack[-1].tag in closes:
            leave()
        if tag == "body" and opened["head"]:
            while leave().tag != "head":
                pass
        top = stack[-1]
        if tag == "hr":
            top.pieces.append(BREAK)
            continue
        own_header = tag == "header" and (opened["article"] or opened["main"])
        outside = top.outside or tag in OUTSIDE and not own_header or "hidden" in names
        classes = ".".join(sorted(set(DIGITS.sub("0", names.get("class", "")).lower().replace("/", "|").split())))
        step = "" if tag in ("html", "body") else f"{tag}{'.' + classes if classes else ''}".replace("/", "|")
        node = Node(tag, step, top, outside, named, spoken)
        node.listed, node.replies = listed, replies
        top.pieces.append(node)
        stack.append(node)
        opened[tag] += 1
        top = node


def nodes_of(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [p for p in reversed(n.pieces) if isinstance(p, Node)]
    return out


def best_container(root: Node) -> tuple[Node, float]:
    """The container with the most running text of its own: its own text and that of the blocks in it that are no
    containers; text in containers inside counts half, so the closest container of a text wins, but one that holds
    many parts of it wins over each part. Article and main count double."""
    nodes = nodes_of(root)
    score = {id(n): 0.0 for n in nodes}
    best, most = root, -1.0
    for n in reversed(nodes):
        own = score[id(n)] + max(0.0, n.text)
        container = n.tag in CONTAINERS or n is root
        if container and not n.outside:
            value = own * (2.0 if n.tag in ("article", "main") else 1.0)
            if value >= most:  # from the last to the first
                best, most = n, value
        if n.up is not None and not n.outside:
            score[id(n.up)] += own * (0.5 if container else 1.0)
    return best, max(most, 0.0)


def chosen(root: Node) -> tuple[list[Node], float]:
    """The elements that hold the main text, and the best container's score. What lies beside the best container and holds links alone
    is marked as outside."""
    best, score = best_container(root)
    nodes = nodes_of(root)
    above = set()
    n = best
    while n is not None:
        above.add(id(n))
        n = n.up
    within: dict[int, bool] = {}  # in article or main
    beside: dict[int, bool] = {}  # not in the best container
    for n in nodes:
        up = n.up
        within[id(n)] = up is not None and within[id(up)] or n.tag in ("article", "main")
        beside[id(n)] = n is not best and (up is None or beside[id(up)])
    running = {id(n): int(not n.outside and n.text > 0) for n in nodes}
    linked = {id(n): n.links for n in nodes}
    wanted = dict(running)
    if within[id(best)]:
        for n in nodes:
            own_title = n.tag == "h1" and not n.outside and n.up is not None and id(n.up) in above and n.up.tag not in ("html", "body")
            wanted[id(n)] = running[id(n)] if within[id(n)] else int(own_title)
    for n in reversed(nodes):
        if n.up is not None:
            for of in (running, linked, wanted):
                of[id(n.up)] += of[id(n)]
    for n in nodes:
        k = id(n)
        if beside[k] and k not in above and linked[k] and not running[k] and n.tag in ("ul", "ol", "dl", "table", "div", "section", "td", "li"):
            n.outside = True
    if within[id(best)]:
        tops = [n for n in nodes if n.tag in ("article", "main") and not n.outside and wanted[id(n)] and not (n.up is not None and within[id(n.up)])]
        if tops and sum(wanted[id(n)] for n in tops) == wanted[id(root)]:
            return tops, score
    n = best
    while n.up is not None and wanted[id(n)] < wanted[id(root)]:
        n = n.up
    return [n], score


def text_of(nodes: list[Node]) -> str:
    """Blocks of the nodes in page order, without what is outside the main text."""
    blocks, line = [], []

    def close() -> None:
        if line and (text := BLANKS.sub(" ", entities.unescape("".join(line))).strip()):
            blocks.append(text)
        line.clear()

    for root in nodes:
        stack: list = [root]
        while stack:
            p = stack.pop()
            if isinstance(p, str):
                line.append(p)
            elif isinstance(p, Node) and p.inline:
                if not p.outside:
                    stack += reversed(p.pieces)
            elif isinstance(p, Node):
                close()
                if not p.outside or p is root:
                    stack.append(BREAK)
                    stack += reversed(p.pieces)
            else:
                close()
        close()
    return "\n".join(blocks)


def extracted(page: str | None, key: str | None) -> tuple[str, str | None]:
    """The main text and the path that gave it: of the outermost elements at the path that a key names, or (None) of the page's own
    choice; where all text is in elements named as boilerplate, names don't count."""
    if not page:
        return "", None
    root = parse(page)
    own, _ = chosen(root)
    if key is not None:
        found, stack = [], [root]
        while stack:
            n = stack.pop()
            if n.key == key and not n.outside and not n.inline:
                found.append(n)
            else:
                stack += [p for p in reversed(n.pieces) if isinstance(p, Node)]
        if found and (text := text_of(found)):
            return text, found[0].path
    return text_of(own) or text_of(chosen(parse(page, False))[0]), None


def extract(page: str | None, key: str | None) -> str:
    return extracted(page, key)[0]


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, key, votes, score) from pages (url, html)."""

    def factory() -> Callable:
        def work(host: str | None, page: str | None) -> tuple:
            if not page:
                return host, None, 0.0
            nodes, score = chosen(parse(page))
            return host, nodes[0].key, float(score)

        return work

    votes = scan(pages.select("host", "html"), "host string, key string, score double", factory).where("host IS NOT NULL AND key IS NOT NULL AND score > 0")
    return votes.groupBy("host", "key").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, key): one winner for each host."""
    best = F.max_by("key", F.struct(F.col("votes"), F.round("score").alias("score"), F.col("key")))
    return votes.groupBy("host").agg(best.alias("key"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, path (null where the page's own choice gave the text) for every row of pages."""
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    rows = rows.withColumn("host", F.lower(F.nullif(F.regexp_extract("url", HOST, 1), F.lit(""))))
    winners = checkpointed(winning_paths(host_votes(rows)))
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length("key") + F.lit(32))).first()[0] or 0
    joined = rows.join(F.broadcast(winners) if size <= HOSTS_BYTES else winners, "host", "left").select("id", "url", "html", "key")

    def factory() -> Callable:
        def work(page_id, url, page, key) -> tuple:
            text, path = extracted(page, key)
            return page_id, url, text, len(text), path

        return work

    return scan(joined, "page_id bigint, url string, text string, n_chars bigint, path string", factory).withColumnRenamed("page_id", id_col)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html": op6_html}
ORACLE_SQL: dict[str, str] = {}
