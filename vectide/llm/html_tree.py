"""Pages as trees of block elements: tag soup is balanced, inline markup is part of the text around it.

A page's tree holds elements (key, children) and texts. A key is the tag with its classes, id and role, digits aside. Contents of scripts,
styles and other raw elements are no text; comments and unfinished tags are dropped; a "<" that starts no tag is text. An open
paragraph, list item, row or cell ends where the next begins; what is open at the end of the page ends there.
Elements nested deeper than DEPTH add their contents to the one at that depth.
"""

from __future__ import annotations

import html as entities
import re

DEPTH = 60
#: Names of HTML elements.
BLOCK = set("address article aside audio blockquote body button canvas caption center dd details dialog div dl dt embed fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main map menu nav noscript object ol option p picture pre search section select summary svg table tbody td template textarea tfoot th thead tr ul video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>|\Z", re.IGNORECASE) for tag in RAW}
#: An element that begins ends open ones of these names, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
#: A comment; a tag with quoted values; one with unbalanced quotes; other markup; an unfinished tag at the end.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]{0,2000}"|'[^']{0,2000}'|[^'"<>])*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>|<[!?/][^<>]*>|<[A-Za-z/!?][^<>]*\Z""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


class Element:
    """kids: elements and texts in page order; node: of the wrapper, once aligned."""

    __slots__ = ("tag", "key", "kids", "node")

    def __init__(self, tag: str, key: str):
        self.tag, self.key, self.kids, self.node = tag, key, [], None


class Text:
    """A run of text without a block's bound in it; links: its characters inside links."""

    __slots__ = ("text", "links", "node")
    tag = key = "#"
    kids: list = []

    def __init__(self, text: str, links: int):
        self.text, self.links, self.node = text, links, None


def key_of(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), re.sub(r"\d+", "", " ".join(sorted("".join(values).lower().split()))))
    return f"{tag}.{found.get('class', '')}#{found.get('id', '')}@{found.get('role', '') or found.get('itemprop', '')}"[:200] if any(found.values()) else tag


def parse(page: str) -> Element:
    root = Element("", "")
    stack, buffer, links, in_link, at = [root], [], 0, 0, 0

    def flush() -> None:
        nonlocal links
        text = "".join(buffer)
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            stack[-1].kids.append(Text(text, min(links, len(text))))
        buffer.clear()
        links = 0

    while m := TOKEN.search(page, at):
        if m.start() > at:
            buffer.append(page[at : m.start()])
            links += in_link and m.start() - at
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing = name.lower(), m[1] or m[4]
        if tag not in BLOCK and "-" not in tag:
            if tag == "a":
                in_link = int(not closing)
            elif tag == "br":
                buffer.append(" ")
            elif tag in RAW and not closing:
                at = RAW_END[tag].search(page, at).end()
            continue
        flush()
        if closing:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k:
                del stack[k:]
            in_link = in_link and k == 0
            continue
        if stack[-1].tag == "p":
            stack.pop()
        elif len(stack) > 2 and stack[-2].tag == "p":
            del stack[-2:]
        if tag in ENDS:
            ended, within = ENDS[tag]
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in ended or stack[k].tag in within), 0)
            if k and stack[k].tag in ended:
                del stack[k:]
        attributes = m[3] if m[2] else m[6]
        if tag in RAW:
            at = RAW_END[tag].search(page, at).end()
            continue
        e = Element(tag, key_of(tag, attributes))
        stack[-1].kids.append(e)
        if tag not in VOID and not attributes.endswith("/") and len(stack) < DEPTH:
            stack.append(e)
        elif len(stack) >= DEPTH and tag not in VOID:
            stack[-1].kids.pop()
    buffer.append(page[at:])
    flush()
    return root
