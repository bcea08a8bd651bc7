"""Requests with their defaults and checks, as data classes."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the service: query types and sort types.
QUERY_TYPES = {1: "mix", 2: "course", 3: "knowledge", 4: "engineer", 5: "live", 6: "microdegree", 13: "org", 14: "staff", 16: "category", 17: "credit_course"}
SCORE, NATURAL = 1, 2
# Fixed value: organisations that the filter word others leaves out.
LISTED_ORGS = [x.lower() for x in ("TsinghuaX", "NTHU", "NCTU", "MITx", "RiceX", "UC BerkeleyX", "WellesleyX")]


def _list(value: str, kind=str) -> list:
    return [kind(x) for x in value.split(";") if x.strip()] if value else []


@dataclass
class SearchRequest:
    query: str = ""
    owner: list[str] = field(default_factory=list)
    cid: list[int] = field(default_factory=list)
    group: str = ""
    serialized: int | None = None
    org: list[str] | str = field(default_factory=list)
    pn: int = 0
    offset: int = 0
    num: int = 10
    qt: int = 1
    version: int = 1
    home: int = 0
    course_id: str = ""
    hasTA: int | None = None
    persent: int = 6
    process: int = 0
    mode: list[str] = field(default_factory=list)
    course_type: int = 0
    is_paid_only: int = 0
    platform: int = 0
    expiration: int | None = None
    fields_v: int = 0

    @classmethod
    def parse(cls, params: dict[str, str]) -> SearchRequest:
        """From text parameters; unknown ones are ignored, bad numbers are errors."""
        out = cls()
        for name, value in params.items():
            if name in ("owner", "mode"):
                setattr(out, name, _list(value.lower() if name == "owner" else value))
            elif name == "cid":
                out.cid = _list(value, int)
            elif name == "org":
                out.org = "others" if value == "others" else _list(value)
            elif name in ("query", "group", "course_id"):
                setattr(out, name, value.replace("/", " ").strip() if name == "query" else value)
            elif name in cls.__dataclass_fields__ and value != "":
                setattr(out, name, int(value))
        return out.checked()

    @property
    def st(self) -> int:
        """By score if there is a query, else in natural order."""
        return SCORE if self.query else NATURAL

    def checked(self) -> SearchRequest:
        if QUERY_TYPES.get(self.qt) not in ("mix", "course", "knowledge", "engineer", "live", "microdegree"):
            raise ValueError(f"no such query type: {self.qt}")
        if self.version not in (1, 2) or self.home not in (0, 1):
            raise ValueError("version is 1 or 2, home is 0 or 1")
        if self.num < 0 or self.pn < 0 or self.offset < 0:
            raise ValueError("pages are not negative")
        if self.home and self.st == NATURAL and QUERY_TYPES[self.qt] in ("mix", "live", "microdegree"):
            raise ValueError(f"{QUERY_TYPES[self.qt]} needs a query on the home page")
        if self.version == 1 and self.qt == 1 and self.st == NATURAL:
            self.qt = 2  # the first version has no natural order of mixed kinds
        return self


@dataclass
class AppRequest:
    qt: int
    query: str = ""
    cid: list[int] = field(default_factory=list)
    org: str = ""
    pn: int = 0
    offset: int = 0
    num: int = 10
    persent: int = 6
    filters: dict[str, list] = field(default_factory=dict)
    order_time: int = 0
    order_user: int = 0
    time_status: int | None = None

    def checked(self) -> AppRequest:
        if QUERY_TYPES.get(self.qt) not in ("org", "staff", "category", "credit_course"):
            raise ValueError(f"no such query type: {self.qt}")
        if self.num >= 20:
            self.num = 10
        return self


@dataclass
class SuggestRequest:
    query: str
    qt: int = 1
    num: int = 5

    def checked(self) -> SuggestRequest:
        if self.qt not in (1, 2, 3):
            raise ValueError(f"no such dictionary: {self.qt}")
        return self


@dataclass
class RelatedRequest:
    query: str
    num: int = 8

    def checked(self) -> RelatedRequest:
        if not 0 < self.num <= 8:
            raise ValueError("between one and eight related searches")
        return self
