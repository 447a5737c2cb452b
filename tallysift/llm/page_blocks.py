"""Pages as sequences of leaf blocks, their features, and made-up pages whose blocks have known labels."""

import html
import re
import zlib

import numpy as np

from tallysift.llm.decontaminate import WORDS, words_of

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*>", re.S)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text. Of those with raw content, what follows an opening tag is code until some end tag.
RAW = frozenset("script style title textarea iframe".split())
SILENT = RAW | frozenset("template noscript svg math object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
#: An opening tag of the key's kind ends an open one of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
TAG_BUCKETS, WORD_BUCKETS = 512, 512


def blocks_of(page: str | None) -> list[tuple[str, list[str], bool]]:
    """Leaf blocks in page order: text (references decoded, white space single), path tokens, whether it is a link."""
    page, out = page or "", []
    stack: list[tuple[str, list[str]]] = []
    pieces: list[str] = []
    linked = False
    endless: set[str] = set()

    def after(name: str, at: int) -> int:
        """Where the page goes on after the opening tag of a silent element. Without an end tag raw content reaches to
        the parent's, or else to the page's end; other elements are passed over as if they were empty."""
        for tag in (name, *([stack[-1][0]] if name in RAW and stack else [])):
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if end:
                return end.end() if tag == name else end.start()
            endless.add(tag)
        return len(page) if name in RAW else at

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((text, [t for _, own in stack for t in own], linked))
            pieces.clear()
        linked = False

    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            pieces.append(page[at:m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in INLINE:
                        flush()
                    del stack[k:]
                    break
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in SILENT:
            if not m[3].endswith("/"):
                at = after(name, at)
            continue
        if name not in INLINE:
            flush()
            ends = CLOSES.get(name, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ("p", "option") or stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        elif name == "a":
            linked = True
        if name not in VOID:
            own = [name]
            for found in NAMED.findall(m[3]):
                own += [f"{name}.{t}" if t in INLINE else f".{t}" for t in re.split(r"[\s_-]+", "".join(found).lower()) if t]
            stack.append((name, own))
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


class Features:
    """A list of pages' blocks as flat arrays: bucket numbers with the block each belongs to, and a few figures."""

    def __init__(self, pages: list[list[tuple[str, list[str], bool]]]):
        blocks = [b for p in pages for b in p]
        self.sizes = np.array([len(p) for p in pages], np.int64)
        tags = [[zlib.crc32(t.encode()) % TAG_BUCKETS for t in path] for _, path, _ in blocks]
        self.tag_of = np.repeat(np.arange(len(blocks)), [len(t) for t in tags])
        self.tag = np.array([x for t in tags for x in t], np.int64)
        texts = [t.encode() for t, _, _ in blocks]
        starts, _, h = words_of(b"\0".join(texts).translate(WORDS)) if blocks else (np.zeros(0, np.int64),) * 3
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.word_of = np.searchsorted(begins, starts, "right") - 1
        self.word = (h.astype(np.uint64) >> np.uint64(55)).astype(np.int64) % WORD_BUCKETS
        n_words = np.bincount(self.word_of, minlength=len(blocks)) if blocks else np.zeros(0)
        place = np.concatenate([(np.arange(n) + 1) / (n + 1) for n in self.sizes]) if blocks else np.zeros(0)
        self.figures = np.stack([np.log1p(n_words) / 5, np.array([float(b[2]) for b in blocks]), place,
                                 np.array([t[-1:] in ".!?" for t, _, _ in blocks], float)], axis=1) if blocks else np.zeros((0, 4))


def invented(n: int, seed: int) -> list[tuple[list[tuple[str, list[str], bool]], np.ndarray]]:
    """Made-up pages with labels: usual page furniture around an article whose container varies."""
    rng = np.random.default_rng(seed)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    known = ["".join(rng.choice(syllables, k)) for k in (1, 2, 2, 3, 3, 4) for _ in range(200)]

    def words(low: int, high: int) -> str:
        return " ".join(known[k] for k in rng.integers(0, len(known), rng.integers(low, high))).capitalize()

    def links() -> str:
        return "".join(f"<li><a href='#'>{words(1, 3)}</a></li>" for _ in range(rng.integers(2, 8)))

    def paragraphs(low: int, high: int) -> str:
        return "".join(f"<p>{words(4, 60)}.</p>" for _ in range(rng.integers(low, high)))

    def pick(*options: str) -> str:
        return options[rng.integers(len(options))]

    menus = ("<nav><ul>{links}</ul></nav>", "<div class='menu'><ul>{links}</ul></div>", "<ul id='navigation'>{links}</ul>",
             "<div class='breadcrumb'><ul>{links}</ul></div>")
    heads = ("<header><h1>{short}</h1><p>{short}</p></header>", "<div id='header'><p>{short}</p></div>",
             "<div class='masthead top'>{short}</div>")
    feet = ("<footer><p>&copy; {short}</p></footer>", "<div class='footer'><p>{short}</p><ul>{links}</ul></div>",
            "<footer>&copy; {short} &middot; {short}</footer>", "<div id='copyright'>{short}</div>")
    sides = ("<aside><h3>{short}</h3>{some}</aside>", "<div class='sidebar'><h3>{short}</h3><ul>{links}</ul></div>",
             "<div class='related'><h3>{short}</h3><ul>{links}</ul></div>", "<div class='widget'>{some}</div>")
    extras = ("<div class='ad'>{short}.</div>", "<div class='advert banner'><p>{short}</p></div>",
              "<div class='ads sponsored promo'>{short}</div>", "<div class='cookie notice'><p>{short}.</p></div>",
              "<div class='alert notification consent'>{short}.</div>", "<div class='social share'><ul>{links}</ul></div>",
              "<form><label>{short}</label><p>{short}</p><button>{short}</button></form>",
              "<div class='newsletter subscribe'><form><p>{short}</p></form></div>", "<div class='popup modal'>{some}</div>",
              "<datalist><option value='a'>{short}<option value='b'>{short}</datalist>")
    talk = ("<section class='comments'><h3>{short}</h3>{some}</section>",
            "<div id='comments'><div class='comment'><p>{short}</p></div><div class='comment'>{some}</div></div>",
            "<ol class='commentlist'><li class='comment'><p>{short}.</p></li></ol>", "<div class='replies discussion'>{some}</div>")
    homes = (("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
             ("<div class='content'>", "</div>"), ("<div class='post entry'>", "</div>"), ("<div id='article body'>", "</div>"),
             ("<div class='story text'>", "</div>"), ("<section>", "</section>"))

    def wrapped(part: str) -> str:
        """Inside up to a dozen elements with names that say nothing."""
        depth = int(rng.integers(1, 13)) if rng.random() < 0.3 else 0
        return "".join(f"<div class='{words(1, 4).lower()}'>" for _ in range(depth)) + part + "</div>" * depth

    def fill(part: str) -> str:
        while (k := re.search(r"\{(\w+)\}", part)) is not None:
            put = {"links": links, "short": lambda: words(2, 14), "some": lambda: paragraphs(1, 4)}[k[1]]()
            part = part[:k.start()] + put + part[k.end():]
        return part

    out = []
    for _ in range(n):
        opening, closing = homes[rng.integers(len(homes))]
        inner = "".join((
            pick(f"<h1>{words(3, 12)}</h1>", f"<h1>{words(3, 12)}</h1><h2>{words(3, 9)}</h2>", ""),
            pick("", f"<p><b>{words(3, 12)}.<br><p>{words(5, 40)}."), paragraphs(1, 7),
            pick("", f"<blockquote><p>{words(6, 30)}.</p></blockquote>", f"<ul><li>{words(3, 12)}</li><li>{words(3, 12)}</li></ul>",
                 f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>", f"<h2>{words(2, 8)}</h2>"), paragraphs(0, 4)))
        inner = wrapped(inner)
        before = [fill(pick(*menus))] + [fill(pick(*p)) for p in (heads, extras, sides) if rng.random() < 0.5]
        after = [fill(pick(*feet))] + [fill(pick(*p)) for p in (talk, sides, extras) if rng.random() < 0.5]
        rng.shuffle(before)
        after = after[1:] + after[:1]
        inside = wrapped("".join(fill(pick(*p)) for p in (extras, talk) if rng.random() < 0.2))
        before, after = ([re.sub("^(<[^>]*>)(.*)(</[^>]*>)$", lambda m: m[1] + wrapped(m[2]) + m[3], p) for p in parts] for parts in (before, after))
        parts = [(p, 0) for p in before] + [(inner, 1), (inside, 0)] + [(p, 0) for p in after]
        marked = "".join(f"{opening if p is inner else ''}{re.sub('>([^<]+)', rf'>{y}\\1', p)}"
                         f"{closing if p is inside else ''}" for p, y in parts)
        page = blocks_of("<html><body>" + marked + "</body></html>")
        labels = np.array([float(t[1:2] == "1") for t, _, _ in page])
        page = [(re.sub("[01]", "", t), path, a) for t, path, a in page]
        if page:
            out.append((page, labels))
    return out
