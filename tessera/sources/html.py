"""H1, H2, H4, H6, H8: what pages say, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: elements whose text nobody sees
HIDDEN = {"script", "style", "noscript", "template"}
SOCIAL = ("linkedin.com", "facebook.com", "instagram.com", "twitter.com", "youtube.com")


class Page(HTMLParser):
    """title, lang, headings, meta, links, mail links, JSON-LD documents and the visible text of a page. Broken markup is read as far as it goes."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.title, self.lang, self.heading, self.meta, self.links, self.mails, self.json, self.text = "", "", "", {}, [], [], [], []
        self._open: list[str] = []
        self._ld = False
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "meta":
            name = a.get("name") or a.get("property")
            if name:
                self.meta.setdefault(name.lower(), a.get("content", ""))
        elif tag == "a" and a.get("href"):
            href = a["href"]
            if href.lower().startswith("mailto:"):
                self.mails.append(href[7:].split("?")[0])
            else:
                self.links.append(href)
        if tag in HIDDEN | {"title", "h1"}:
            self._open.append(tag)
            self._ld = tag == "script" and "ld+json" in a.get("type", "").lower()

    def handle_endtag(self, tag):
        if tag in self._open:
            while self._open and self._open.pop() != tag:
                pass

    def handle_data(self, data):
        inside = self._open[-1] if self._open else ""
        if inside == "script" and self._ld:
            self.json += _documents(data)
        elif inside == "title":
            self.title += data
        elif inside not in HIDDEN:
            self.text.append(data)
            if inside == "h1":
                self.heading += data


def _documents(data: str) -> list[dict]:
    try:
        found = json.loads(data)
    except ValueError:
        return []
    flat, todo = [], [found]
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo += x
        elif isinstance(x, dict):
            flat.append(x)
            todo += x["@graph"] if isinstance(x.get("@graph"), list) else []
    return flat


def _text(value) -> str:
    return " ".join(str(value).split()) if isinstance(value, str | int | float) else ""


def _name(value) -> str:
    return _text(value.get("name")) if isinstance(value, dict) else _text(value)


def posting(page: Page) -> dict[str, str]:
    """H1: the posting's title, company, city, country and date, from JSON-LD, then meta, then headings, each with where it comes from."""
    own = next((x for x in page.json if "JobPosting" in str(x.get("@type"))), {})
    place = own.get("jobLocation")
    place = place[0] if isinstance(place, list) and place else place
    address = place.get("address") if isinstance(place, dict) else {}
    address = address if isinstance(address, dict) else {}
    title = _text(own.get("title"))
    source = "JSON_LD" if title else ""
    if not title and _text(page.meta.get("og:title")):
        title, source = _text(page.meta["og:title"]), "META"
    if not title and _text(page.heading):
        title, source = _text(page.heading), "HEADING"
    if not title and _text(page.title):
        title, source = _text(page.title), "TITLE"
    return {"job_title": title, "title_source": source, "company": _name(own.get("hiringOrganization")), "city": _text(address.get("addressLocality")), "country": _name(address.get("addressCountry")), "published_at": _text(own.get("datePosted"))}


FIELDS = "title string, lang string, heading string, n_links int, mails array<string>, social array<string>, people array<string>, organisations array<string>, visible_chars int, job_title string, title_source string, company string, city string, country string, published_at string"


def _row(html) -> dict:
    page = Page(html if isinstance(html, str) else "")
    names = lambda kind: list(dict.fromkeys(n for n in (_name(x) for x in page.json if kind in str(x.get("@type"))) if n))
    social = [next((u for u in page.links if f"//{s}/" in u or f"//www.{s}/" in u), None) for s in SOCIAL]
    return {
        "title": _text(page.title), "lang": page.lang, "heading": _text(page.heading), "n_links": len(page.links), "mails": list(dict.fromkeys(page.mails)), "social": [u for u in social if u],
        "people": names("Person"), "organisations": names("Organization"), "visible_chars": len(" ".join("".join(page.text).split())), **posting(page),
    }


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and FIELDS of each page; null pages are empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([_row(h) for h in frame[html]], columns=[f.split(" ")[0] for f in FIELDS.split(", ")])
            out.insert(0, key, frame[key].to_numpy())
            yield out

    return pages.select(key, html).mapInPandas(run, f"{key} bigint, {FIELDS}")


def visible(html: Column) -> Column:
    """The text of a page by patterns alone, in the JVM: hidden elements and tags dropped, white space collapsed, entities as they are."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
