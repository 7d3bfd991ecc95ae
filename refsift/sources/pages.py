"""Web pages of sources as records: a page becomes a tree of elements, and each kind of page says where in it papers stand."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

#: Elements without an end, and those that end where one of the same group begins.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSING = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


@dataclass
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    inside: list[Element | str] = field(default_factory=list)

    def all(self, *tags: str) -> Iterator[Element]:
        """Descendants with one of these tags, in the page's order."""
        waiting = list(reversed(self.inside))
        while waiting:
            x = waiting.pop()
            if isinstance(x, Element):
                if x.tag in tags:
                    yield x
                waiting.extend(reversed(x.inside))

    def first(self, *tags: str) -> Element | None:
        return next(self.all(*tags), None)

    def pieces(self) -> Iterator[str]:
        waiting = list(reversed(self.inside))
        while waiting:
            x = waiting.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in ("script", "style", "#comment"):
                waiting.extend(reversed(x.inside))

    @property
    def text(self) -> str:
        """All text in it, spaces collapsed."""
        return " ".join("".join(self.pieces()).split())

    @property
    def link(self) -> str:
        return self.attributes.get("href", "")

    def has_class(self, name: str) -> bool:
        return name in self.attributes.get("class", "").lower().split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#page")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.open[-1].tag in CLOSING.get(tag, ()):
            self.open.pop()
        made = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inside.append(made)
        if tag not in VOID:
            self.open.append(made)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].inside.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        depth = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if depth is not None:
            del self.open[depth:]

    def handle_data(self, data: str) -> None:
        self.open[-1].inside.append(data)

    def handle_comment(self, data: str) -> None:
        self.open[-1].inside.append(Element("#comment", {"says": " ".join(data.split())}))


def tree(page: str) -> Element:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def after(parent: Element, child: Element) -> Element:
    """What stands in parent behind child."""
    at = next((i for i, x in enumerate(parent.inside) if x is child), len(parent.inside) - 1)
    return Element("#rest", {}, parent.inside[at + 1 :])


def year_of(text: str) -> int | None:
    found = re.search("(?:18|19|20|21)[0-9]{2}", text or "")
    return int(found[0]) if found else None


def names_of(text: str) -> list[str]:
    """Names between commas or the word `and`; stars are footnote marks."""
    listed = re.sub(r"\s+and\s+", ",", text.replace("*", "")).split(",")
    return [n for n in map(str.strip, listed) if n]


# Citation data of a page

#: Names of meta elements, the first that a page has counts.
META_TITLE = (
    "citation_title",
    "dc.title",
    "dcterms.title",
    "og:title",
    "twitter:title",
)
META_AUTHORS = (
    "citation_author",
    "dc.creator",
    "dcterms.creator",
    "author",
)
META_DATE = (
    "citation_publication_date",
    "citation_date",
    "dc.date",
    "dcterms.date",
    "date",
)
META_VENUE = (
    "citation_conference_title",
    "citation_journal_title",
    "dc.source",
)
META_DOI = (
    "citation_doi",
    "dc.identifier",
)
#: The service whose notes name authors and date in their text, what its titles end with, and their venue.
NOTE_HOST, NOTE_ENDING, NOTE_VENUE = "notion.site", "notion", "Notion Blog"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


class Citation:
    """What the meta elements of a page say."""

    def __init__(self, page: Element):
        self.said: dict[str, list[str]] = {}
        for meta in page.all("meta"):
            content = meta.attributes.get("content", "").strip()
            label = meta.attributes.get("name") or meta.attributes.get("property")
            if label and content:
                self.said.setdefault(label.lower(), []).append(content)

    def all(self, names: tuple[str, ...]) -> list[str]:
        return next((self.said[n] for n in names if n in self.said), [])

    def one(self, *names: str) -> str:
        return next(iter(self.all(names)), "")


def note_authors(page: Element) -> list[str]:
    """Of a note's first paragraph the links, if there is one for each name between commas; else these names."""
    body = page.first("body")
    paragraph = body.first("p") if body else None
    if paragraph is None:
        return []
    linked = [t for a in paragraph.all("a") if (t := a.text)]
    if len(linked) > paragraph.text.count(","):
        return linked
    # Marks like $^1$ refer to affiliations.
    bare = "".join(p for i, p in enumerate(re.split(r"\$\^|\$", paragraph.text)) if i % 2 == 0) if "$^" in paragraph.text else paragraph.text
    return [n for n in (x.strip().rstrip("*").strip() for x in bare.split(",")) if n]


def note_date(page: Element) -> str:
    """The first date behind a dash, as `Mar 4, 2024`."""
    body = page.first("body")
    for found in re.finditer("[—-]\\s*([A-Za-z]+) +([0-9]{1,2}), +([0-9]{4})", body.text if body else ""):
        if found[1][:3].lower() in MONTHS:
            return f"{found[1]} {found[2]}, {found[3]}"
    return ""


@dataclass(frozen=True)
class Page:
    title: str
    authors: list[str]
    date: str
    venue: str
    doi: str
    note: bool


def cited_page(url: str, body: str) -> Page | None:
    """A page's own citation data, its title where it has none; nothing for files that are no pages, and pages without a title."""
    if not url or url.lower().partition("?")[0].endswith(".pdf") or body.lstrip().startswith("%PDF-"):
        return None
    page = tree(body)
    cited, note = Citation(page), NOTE_HOST in url.lower()
    heading = page.first("title")
    title = cited.one(*META_TITLE) or (heading.text if heading else "")
    if note and title.rpartition("|")[2].strip().lower() == NOTE_ENDING and "|" in title:
        title = title.rpartition("|")[0]
    if not title.strip():
        return None
    authors = cited.all(META_AUTHORS) or (note_authors(page) if note else [])
    date = cited.one(*META_DATE) or (note_date(page) if note else "")
    venue = cited.one(*META_VENUE) or (NOTE_VENUE if note else "")
    return Page(title.strip(), [a.strip() for a in authors], date, venue.strip(), cited.one(*META_DOI), note)


# Papers of proceedings pages


@dataclass(frozen=True)
class Paper:
    title: str
    authors: list[str]
    link: str
    year: int | None = None


def listed_papers(page: Element) -> Iterator[Paper]:
    """Items that say a year in brackets, a linked title, and the authors behind it."""
    for item in page.all("li"):
        link = next((x for x in item.inside if isinstance(x, Element) and x.tag == "a" and x.link), None)
        before = "".join(x for x in item.inside[: item.inside.index(link)] if isinstance(x, str)).strip() if link else ""
        if before[:1] == "(" and before[-1:] == ")" and before[1:-1].strip().isdigit():
            yield Paper(link.text, names_of(after(item, link).text), link.link, year_of(before))


def boxed_papers(page: Element) -> Iterator[Paper]:
    """Boxes of class paper with a title, authors and a link named abs."""
    for box in page.all("div"):
        if box.has_class("paper"):
            title = next((p for p in box.all("p") if p.has_class("title")), None)
            authors = next((s for s in box.all("span") if s.has_class("authors")), None)
            link = next((a for a in box.all("a") if a.text.lower() == "abs" and a.link.lower().endswith(".html")), None)
            if title and authors and link:
                yield Paper(title.text, names_of(authors.text), link.link)


def defined_papers(page: Element, link_ending: str = "") -> Iterator[Paper]:
    """Terms of class ptitle with a link, and behind each its authors: the values of form fields, or the text."""
    term = None
    for x in page.all("dt", "dd"):
        if x.tag == "dt":
            term = next((a for a in x.all("a") if a.link.endswith(link_ending) and a.link), None) if x.has_class("ptitle") else None
        elif term is not None:
            fields = [i.attributes.get("value", "").strip() for i in x.all("input") if i.attributes.get("name") == "query_author"]
            yield Paper(term.text, [f for f in fields if f] or names_of(x.text), term.link)
            term = None


def volume_papers(page: Element) -> Iterator[Paper]:
    """Terms that are titles, and behind each the authors in bold italics, pages, year and links."""
    term = None
    for x in page.all("dt", "dd"):
        if x.tag == "dt":
            term = x
        elif term is not None:
            bold = x.first("b")
            italic = bold.first("i") if bold else None
            link = next((a for a in x.all("a") if a.link.startswith("/papers/v") and a.link.endswith(".html")), None)
            if italic and link:
                yield Paper(term.text, names_of(italic.text), link.link, year_of(after(x, bold).text))
            term = None


def year_section(page: Element, conference: str, year: int | None) -> Element:
    """What stands between the comment that names a conference and year and the next that names the conference."""
    inside, section = False, None
    waiting = [iter(page.inside)]
    while waiting:
        x = next(waiting[-1], None)
        if x is None:
            waiting.pop()
            continue
        if isinstance(x, Element) and x.tag == "#comment":
            said = x.attributes["says"].lower().split()
            if len(said) == 2 and said[0] == conference.lower() and said[1].isdigit():
                inside = section is None and int(said[1]) == year
                section = Element("#section") if inside else section
        elif isinstance(x, Element) and any(True for _ in x.all("#comment")):
            waiting.append(iter(x.inside))
        elif inside:
            section.inside.append(x)
    if section is None:
        raise ValueError(f"no {conference} section of {year}")
    return section


def papers_of(source: str, body: str, year: int | None) -> Iterator[Paper]:
    page = tree(body)
    if source in ("iclr", "neurips"):
        return listed_papers(page)
    if source == "icml":
        return boxed_papers(page)
    if source in ("cvpr", "iccv"):
        return defined_papers(page, "_paper.html")
    if source == "eccv":
        return defined_papers(year_section(page, "ECCV", year))
    if source == "jmlr":
        return volume_papers(page)
    raise ValueError(f"no pages known of {source}")


# Addresses of volumes

#: The volume of each year's conference.
ICML_VOLUMES = {
    2013: 28,
    2014: 32,
    2015: 37,
    2016: 48,
    2017: 70,
    2018: 80,
    2019: 97,
    2020: 119,
    2021: 139,
    2022: 162,
    2023: 202,
    2024: 235,
    2025: 267,
}
#: What the publisher's index calls the conference.
ICML_LABELS = (
    "proceedings of icml",
    "international conference on machine learning",
)


def icml_volume(year: int, index: str = "") -> int:
    """The volume of a year, from the table or from the publisher's index page."""
    if year in ICML_VOLUMES:
        return ICML_VOLUMES[year]
    for item in tree(index).all("li"):
        link = item.first("a")
        if link is None or not (link.link[:1] == "v" and link.link[1:].isdigit()):
            continue
        label = " ".join("".join(c if c.isalnum() else " " for c in after(item, link).text.lower()).split())
        if str(year) in label and any(name in label for name in ICML_LABELS):
            return int(link.link[1:])
    raise ValueError(f"no ICML volume of {year}")


def volume_ids(body: str, venue: str, year: int) -> list[str]:
    """Volumes of a year on a venue's page: those that follow its event's link, else those named after year and venue."""
    of_event: list[str] = []
    all_: list[str] = []
    current = None
    for a in tree(body).all("a"):
        kind, _, name = a.link.strip("/").lower().partition("/")
        if kind == "events" and name == f"{venue}-{a.text}":
            current = a.text
        elif kind == "volumes" and name:
            volume = a.link.strip("/").partition("/")[2]
            all_.append(volume)
            if current == str(year):
                of_event.append(volume)
    named = [v for v in all_ if v.lower().startswith(f"{year}.{venue}-")]
    return list(dict.fromkeys(of_event or named))


def absolute(base: str, link: str) -> str:
    return urljoin(base, link)
