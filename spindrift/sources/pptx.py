"""Presentations read with the standard library: a package of XML parts, their relations and media."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from datetime import datetime
from xml.etree import ElementTree
from xml.sax.saxutils import escape

#: Namespaces of the format.
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
CORE = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
DC, TERMS = "http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/"
BODY = 1500


class Package:
    def __init__(self, content: bytes):
        self.parts = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.parts.namelist())

    def xml(self, name: str) -> ElementTree.Element | None:
        return ElementTree.fromstring(self.parts.read(name)) if name in self.names else None

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id: (kind, part) of what a part refers to."""
        folder, name = posixpath.split(part)
        found = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in found if found is not None else ():
            if r.get("TargetMode") != "External":
                target = r.get("Target")
                path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[r.get("Id")] = (r.get("Type").rsplit("/", 1)[-1], path)
        return out

    def slides(self) -> Iterator[str]:
        """The parts of the slides, in order."""
        related = self.relations("ppt/presentation.xml")
        for s in self.xml("ppt/presentation.xml").iter(f"{{{P}}}sldId"):
            kind, part = related.get(s.get(f"{{{R}}}id"), ("", ""))
            if part in self.names:
                yield part


def _text(shape: ElementTree.Element) -> str:
    """A shape's paragraphs as lines."""
    body = shape.find(f"{{{P}}}txBody")
    if body is None:
        return ""
    parts = {f"{{{A}}}t": lambda e: e.text or "", f"{{{A}}}br": lambda e: "\v"}
    return "\n".join("".join(parts[e.tag](e) for e in paragraph.iter() if e.tag in parts) for paragraph in body.iter(f"{{{A}}}p"))


def _placeholder(shape: ElementTree.Element) -> str | None:
    found = shape.find(f"{{{P}}}nvSpPr/{{{P}}}nvPr/{{{P}}}ph")
    return None if found is None else found.get("type", "obj")


def texts(slide: ElementTree.Element) -> tuple[str | None, str]:
    """(title, body) of a slide: the title's shape or the first line of any, and all other texts once each."""
    shapes = [(s, _text(s).strip(), _placeholder(s)) for s in slide.findall(f"{{{P}}}cSld/{{{P}}}spTree/{{{P}}}sp")]
    own = next((s for s, _, kind in shapes if kind in ("title", "ctrTitle")), None)
    title = next((t for s, t, _ in shapes if s is own and t), None)
    if title is None:
        title = next((line for _, t, _ in shapes if t for line in [t.splitlines()[0].strip()] if line), None)
    head = title.splitlines()[0].strip() if title else None
    body: dict[str, None] = {}
    for s, t, _ in shapes:
        if s is not own and t and not (head == t.splitlines()[0].strip() and len(t.splitlines()) == 1):
            body[t] = None
    return title, "\n\n".join(body)


def _pictures(tree: ElementTree.Element) -> Iterator[str]:
    """The relation ids of pictures, groups included, in order."""
    for e in tree:
        if e.tag == f"{{{P}}}pic":
            for blip in e.iter(f"{{{A}}}blip"):
                if blip.get(f"{{{R}}}embed"):
                    yield blip.get(f"{{{R}}}embed")
        elif e.tag == f"{{{P}}}grpSp":
            yield from _pictures(e)


def _time(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None) if text else None
    except ValueError:
        return None


def read(content: bytes) -> tuple[dict, list[dict]]:
    """(properties, slides): author, created_at, modified_at; and of each slide its title, body, notes and pictures."""
    package = Package(content)
    core = package.xml("docProps/core.xml")
    value = lambda tag: (core.findtext(tag) or "").strip() or None if core is not None else None
    about = {"author": value(f"{{{DC}}}creator") or value(f"{{{CORE}}}lastModifiedBy"), "created_at": _time(value(f"{{{TERMS}}}created")), "modified_at": _time(value(f"{{{TERMS}}}modified"))}
    slides = []
    for part in package.slides():
        slide, related = package.xml(part), package.relations(part)
        title, body = texts(slide)
        notes = None
        for kind, target in related.values():
            if kind == "notesSlide" and target in package.names:
                notes = next((_text(s).strip() for s in package.xml(target).iter(f"{{{P}}}sp") if _placeholder(s) == "body"), "") or None
        body = body if len(body) <= BODY else body[: BODY - 3].rstrip() + "..."
        pictures = [package.parts.read(related[i][1]) for i in _pictures(slide.find(f"{{{P}}}cSld/{{{P}}}spTree")) if i in related and related[i][1] in package.names]
        slides.append({"title": title, "body": body or None, "notes": notes, "pictures": pictures})
    return about, slides


def written(slides: list[dict], author: str = "") -> bytes:
    """A minimal presentation of slides (title, body, notes, pictures): what examples and tests are made of."""
    out = io.BytesIO()
    names = f'xmlns:a="{A}" xmlns:p="{P}" xmlns:r="{R}"'

    def shape(n: int, kind: str, text: str) -> str:
        lines = "".join(f"<a:p><a:r><a:t>{escape(line)}</a:t></a:r></a:p>" for line in text.split("\n"))
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{n}" name="s{n}"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{lines}</p:txBody></p:sp>'

    def rels(entries: list[tuple[str, str, str]]) -> str:
        return f'<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="{i}" Type="{R}/{kind}" Target="{target}"/>' for i, kind, target in entries) + "</Relationships>"

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("docProps/core.xml", f'<c:coreProperties xmlns:c="{CORE}" xmlns:dc="{DC}" xmlns:t="{TERMS}"><dc:creator>{escape(author)}</dc:creator><t:created>2024-01-02T03:04:05Z</t:created></c:coreProperties>')
        z.writestr("ppt/presentation.xml", f"<p:presentation {names}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + n}" r:id="r{n}"/>' for n in range(len(slides))) + "</p:sldIdLst></p:presentation>")
        z.writestr("ppt/_rels/presentation.xml.rels", rels([(f"r{n}", "slide", f"slides/slide{n}.xml") for n in range(len(slides))]))
        for n, s in enumerate(slides):
            pictures = s.get("pictures") or []
            shapes = (shape(2, "title", s["title"]) if s.get("title") else "") + (shape(3, "body", s["body"]) if s.get("body") else "")
            shapes += "<p:grpSp>" + "".join(f'<p:pic><p:blipFill><a:blip r:embed="p{k}"/></p:blipFill></p:pic>' for k in range(len(pictures))) + "</p:grpSp>"
            z.writestr(f"ppt/slides/slide{n}.xml", f"<p:sld {names}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>")
            entries = [(f"p{k}", "image", f"../media/image{n}x{k}.png") for k in range(len(pictures))]
            if s.get("notes"):
                entries.append(("n", "notesSlide", f"../notesSlides/notes{n}.xml"))
                z.writestr(f"ppt/notesSlides/notes{n}.xml", f"<p:notes {names}><p:cSld><p:spTree>{shape(2, 'body', s['notes'])}</p:spTree></p:cSld></p:notes>")
            z.writestr(f"ppt/slides/_rels/slide{n}.xml.rels", rels(entries))
            for k, picture in enumerate(pictures):
                z.writestr(f"ppt/media/image{n}x{k}.png", picture)
    return out.getvalue()
