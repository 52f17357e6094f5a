"""Criteria of a tender from its HTML page: 19 fields. The standard library's parser, in Arrow batches on the executors.

The page becomes a tree of elements; each field is where its label says: in the label's next list, or in the value box that
follows it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Labels of the pages, by field. Fixed values.
LABELS = {
    "regulacion_armonizada": "Contrato Sujeto a regulación armonizada", "directiva_aplicacion": "Directiva de aplicación", "plazo_ejecucion": "Plazo de Ejecución", "descripcion_procedimiento": "Descripción del procedimiento",
    "condiciones_especiales": "Condiciones especiales de ejecución de Contrato", "garantia": "Garantía Requerida", "definitiva": "Definitiva", "complementaria": "Complementaria", "porcentaje": "Porcentaje",
    "garantia_plazo": "Plazo de constitución", "requisitos": "Requisitos de participación", "num_empleados": "Número de Empleados", "clasificacion_empresarial": "Clasificación empresarial", "condiciones_admision": "Condiciones de admisión",
    "motivos_exclusion": "Motivos de exclusión", "sobres": "Preparación de oferta", "sobre": "Sobre", "tipo_oferta": "Tipo de Oferta", "criterios_adjudicacion": "Criterios de Adjudicación", "subtipo": "Subtipo Criterio",
    "ponderacion": "Ponderación", "plazo_validez_oferta": "Plazo de Validez de la Oferta", "apertura": "Apertura de Ofertas", "lugar": "Lugar",
}
#: What marks a link to a document, and the date of the opening. Fixed values.
DOCUMENT_HOSTS, OPENING = ("GetDocumentByIdServlet", "drive.google.com"), ("El día", "a las")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Columns after page_id, as Spark and as Arrow types.
FIELDS: dict[str, tuple[str, pa.DataType]] = {
    "title": ("string", pa.string()), "n_links": ("int", pa.int32()), "regulacion_armonizada": ("boolean", pa.bool_()), "directiva_aplicacion": ("string", pa.string()), "plazo_ejecucion": ("string", pa.string()),
    "pdf_links": ("array<struct<nombre:string,url:string>>", pa.list_(pa.struct([("nombre", pa.string()), ("url", pa.string())]))), "descripcion_procedimiento": ("string", pa.string()),
    "condiciones_especiales": ("array<string>", pa.list_(pa.string())), "garantia_definitiva_pct": ("double", pa.float64()), "garantia_plazo_dias": ("int", pa.int32()), "garantia_complementaria_pct": ("double", pa.float64()),
    "num_empleados_min": ("int", pa.int32()), "clasificacion_empresarial": ("array<string>", pa.list_(pa.string())), "condiciones_admision": ("array<string>", pa.list_(pa.string())), "motivos_exclusion": ("array<string>", pa.list_(pa.string())),
    "sobres": ("array<struct<descripcion:string,tipo:string>>", pa.list_(pa.struct([("descripcion", pa.string()), ("tipo", pa.string())]))),
    "criterios_adjudicacion": ("array<struct<nombre:string,subtipo:string,ponderacion:double>>", pa.list_(pa.struct([("nombre", pa.string()), ("subtipo", pa.string()), ("ponderacion", pa.float64())]))),
    "plazo_validez_oferta": ("string", pa.string()), "apertura_fecha": ("string", pa.string()), "apertura_lugar": ("string", pa.string()),
}
SCHEMA = "page_id long, " + ", ".join(f"{k} {v[0]}" for k, v in FIELDS.items())


class Element:
    __slots__ = ("tag", "attrs", "parent", "items", "first", "last", "tree", "label")

    def __init__(self, tag: str, attrs: dict, parent: Element | None, tree: _Builder):
        self.tag, self.attrs, self.parent, self.items, self.tree = tag, attrs, parent, [], tree
        self.first, self.last, self.label = len(tree.elements), None, None
        tree.elements.append(self)
        tree.by_tag.setdefault(tag, []).append(self)

    def walk(self) -> list[Element]:
        """The elements within, in page order: those that begin after this one and before it ends."""
        return self.tree.elements[self.first + 1 : self.last]

    def tagged(self, tag: str) -> list[Element]:
        """The elements of a tag within, in page order."""
        found = self.tree.by_tag.get(tag, [])
        return found[bisect_right(found, self.first, key=_first) : bisect_left(found, len(self.tree.elements) if self.last is None else self.last, key=_first)]

    def texts(self) -> Iterator[str]:
        stack = list(reversed(self.items))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in ("script", "style"):
                stack += reversed(x.items)

    def text(self) -> str:
        return " ".join("".join(self.texts()).split())

    def find(self, tag: str, test: Callable[[Element], bool] = lambda x: True) -> Element | None:
        return next((x for x in self.tagged(tag) if test(x)), None)

    def only_text(self) -> str:
        """The text of an element that holds nothing else, itself or in an only child; else empty. Kept, so that a page is
        asked for its labels once it is whole."""
        if self.label is None:
            self.label = self._only_text()
        return self.label

    def _only_text(self) -> str:
        x = self
        while len(x.items) == 1 and isinstance(x.items[0], Element):
            x = x.items[0]
        return "".join(x.items) if not any(isinstance(y, Element) for y in x.items) else ""

    def labelled(self, tag: str, *labels: str) -> Element | None:
        """The first element of a tag that is a label: it holds all of `labels`, and only text."""
        return self.find(tag, lambda x: all(s in x.only_text() for s in labels))

    def value(self) -> Element | None:
        """The first value box within."""
        return self.find("div", is_value)

    def values(self) -> list[str]:
        return [x.text() for x in self.tagged("div") if is_value(x)]

    def following(self) -> list:
        """What stands after this element under the same parent."""
        for i, x in enumerate(self.parent.items if self.parent else ()):
            if x is self:
                return self.parent.items[i + 1 :]
        return []

    def sibling(self, tag: str, test: Callable[[Element], bool] = lambda x: True) -> Element | None:
        return next((x for x in self.following() if isinstance(x, Element) and x.tag == tag and test(x)), None)


def _first(x: Element) -> int:
    return x.first


def is_value(x: Element) -> bool:
    return x.tag == "div" and "noremarca" in (x.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.by_tag: dict[str, list[Element]] = {}
        self.root = Element("", {}, None, self)
        self.open = [self.root]
        self.count: dict[str, int] = {}

    def updatepos(self, i, j):
        return j  # lines aren't counted

    def handle_starttag(self, tag, attrs):
        node = Element(tag, dict(attrs), self.open[-1], self)
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1
        else:
            node.last = len(self.elements)

    def handle_endtag(self, tag):
        while self.count.get(tag):  # a stray end tag closes nothing
            last = self.open.pop()
            last.last = len(self.elements)
            self.count[last.tag] -= 1
            if last.tag == tag:
                break

    def handle_data(self, data):
        self.open[-1].items.append(data)


def number(text: str | None) -> float | None:
    """The first number of a text, written the Spanish way: 1.000,50."""
    m = re.search(r"[\d,.]+", text or "")
    try:
        return float(m[0].replace(".", "").replace(",", ".")) if m else None
    except ValueError:
        return None


def _text(x: Element | None) -> str | None:
    return x.text() if x is not None else None


def _boxed(within: Element | None, *labels: str) -> str | None:
    """The value box that follows a label."""
    span = within.labelled("span", *labels) if within is not None else None
    return _text(span.sibling("div", is_value)) if span is not None else None


def _list_after(within: Element | None, tag: str, *labels: str) -> Element | None:
    head = within.labelled(tag, *labels) if within is not None else None
    return head.sibling("ul") if head is not None else None


def _procedure(root: Element) -> str | None:
    span = root.labelled("span", LABELS["descripcion_procedimiento"])
    item = span.parent if span is not None else None
    if item is None:
        return None
    after = item.following()
    if after and isinstance(after[0], str):
        return " ".join(after[0].split())
    whole = item.parent.text().replace(LABELS["descripcion_procedimiento"], "").strip() if item.parent is not None else ""
    return whole or None


def _award_criteria(within: Element | None) -> list[dict]:
    out = []
    for ul in [x for x in within.items if isinstance(x, Element) and x.tag == "ul"] if within is not None else []:
        found: dict = {}
        first = ul.find("li")
        if first is not None and first.value() is not None:
            found["nombre"] = first.value().text()
        nested = ul.find("ul")
        for li in nested.tagged("li") if nested is not None else []:
            if li.labelled("span", LABELS["subtipo"]) is not None:
                found["subtipo"] = li.text().split(":")[-1].strip()
            elif li.labelled("span", LABELS["ponderacion"]) is not None and number(li.text()) is not None:
                found["ponderacion"] = number(li.text())
        out += [found] if found else []
    return out


def _envelopes(root: Element) -> list[dict]:
    out = []
    for head in root.tagged("h4"):
        if LABELS["sobres"] in head.text() and (ul := head.sibling("ul")) is not None:
            found = {"descripcion": _boxed(ul, LABELS["sobre"]), "tipo": _boxed(ul, LABELS["tipo_oferta"])}
            out += [found] if any(v is not None for v in found.values()) else []
    return out


def parse(html: str | None) -> dict:
    """The fields of one page; one that the page lacks is null or an empty list."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    root = builder.root
    links = [x for x in root.tagged("a") if x.attrs.get("href")]
    named = [(x.attrs["href"], x.text()) for x in links]
    harmonised = next((x.value().text().lower() for x in root.tagged("h3") if LABELS["regulacion_armonizada"] in x.text() and x.value() is not None), None)
    term = root.labelled("span", LABELS["plazo_ejecucion"])
    term = term.parent.sibling("ul") if term is not None else None
    special = root.labelled("span", LABELS["condiciones_especiales"])
    special = (special.sibling("ul") or special.parent.find("ul")) if special is not None else None
    final, extra = (_list_after(root, "h4", LABELS["garantia"], LABELS[k]) for k in ("definitiva", "complementaria"))
    days = _list_after(final, "h5", LABELS["garantia_plazo"])
    needs = _list_after(root, "h4", LABELS["requisitos"])
    staff = _boxed(needs, LABELS["num_empleados"])
    under = lambda k: _list_after(needs, "h5", LABELS[k])
    values = lambda x: x.values() if x is not None else []
    admission = under("condiciones_admision")
    validity = _list_after(root, "h4", LABELS["plazo_validez_oferta"])
    opened = root.labelled("h3", LABELS["apertura"]) is not None
    place = _list_after(root, "h5", LABELS["lugar"]) if opened else None
    day_number = number(_text(days.value())) if days is not None and days.value() is not None else None
    return {
        "title": _text(root.find("title")), "n_links": len(links), "regulacion_armonizada": None if harmonised is None else harmonised in ("si", "sí"), "directiva_aplicacion": _boxed(root, LABELS["directiva_aplicacion"]),
        "plazo_ejecucion": _text(term.value()) if term is not None else None, "pdf_links": [{"nombre": t, "url": u} for u, t in named if t and any(h in u for h in DOCUMENT_HOSTS)], "descripcion_procedimiento": _procedure(root),
        "condiciones_especiales": values(special), "garantia_definitiva_pct": number(_boxed(final, LABELS["porcentaje"])), "garantia_plazo_dias": int(day_number) if day_number else None,
        "garantia_complementaria_pct": number(_boxed(extra, LABELS["porcentaje"])), "num_empleados_min": None if staff is None else int(number(staff) or 0), "clasificacion_empresarial": values(under("clasificacion_empresarial")),
        "condiciones_admision": [x.text() for x in admission.items if isinstance(x, Element) and x.tag == "li"] if admission is not None else [], "motivos_exclusion": [v for v in values(under("motivos_exclusion")) if v not in ("", "-")],
        "sobres": _envelopes(root), "criterios_adjudicacion": _award_criteria(_list_after(root, "h5", LABELS["criterios_adjudicacion"])), "plazo_validez_oferta": _text(validity.value()) if validity is not None else None,
        "apertura_fecha": next((v for v in reversed(root.values()) if all(s in v for s in OPENING)), None) if opened else None, "apertura_lugar": _text(place.value()) if place is not None else None,
    }


def criteria(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, FIELDS...) of each page."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                p = batch.slice(i, 200)
                found = [parse(x.as_py()) for x in p.column(1)]
                yield pa.RecordBatch.from_arrays([p.column(0).cast(pa.int64()), *[pa.array([f[k] for f in found], t) for k, (_, t) in FIELDS.items()]], ["page_id", *FIELDS])

    return pages.select(page_id, html).mapInArrow(run, SCHEMA)
