"""The fold of lead grouping (E1) over classes of groups, in place of single groups.

Groups with the same evidence, the same pairs and the same addresses are one class. Every row meets all of a class in the same way, so a class of two or more
can never be what one row alone matches: it takes no more rows, and only its review reasons grow. Classes that differ in addresses only make a shape. Rows look
at shapes: reasons are noted there with the number of the row, and a group has those noted after it came in. So a row costs what there are of different shapes
under its keys, not of groups.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

PLACES, SITES, AREA, BRANCHES, BRIDGE, UNCLEAR = (1 << i for i in range(6))
REASONS = {
    PLACES: "conflicting maps identities", SITES: "conflicting strong identities", AREA: "conflicting location evidence",
    BRANCHES: "shared domain across distinct places", BRIDGE: "identity bridge conflict", UNCLEAR: "ambiguous exact-name match",
}
TEXTS = ["; ".join(sorted(text for bit, text in REASONS.items() if mask & bit)) for mask in range(64)]
#: kinds of evidence by strength
MAPS, DOMAIN, NAME_PHONE, NAME_EMAIL, NAME = range(5)
PHONE, EMAIL = 5, 6


class _Class:
    """Groups of a shape with the same addresses. area: the last row that lay apart from all of them, where they are two or more."""

    __slots__ = ("shape", "key", "addresses", "n", "only", "area")

    def __init__(self, key: int, addresses: set[str]):
        self.key, self.addresses, self.n, self.area = key, addresses, 0, 0


class _Shape:
    """marks: all evidence but addresses, as (kind, values); noted: reasons and the last row that gave them. Of rows that lay apart by address: the last one's
    address and number, and the number of the last one with another address."""

    __slots__ = ("key", "marks", "place", "domain", "name", "phone", "email", "n", "classes", "at", "filled", "several", "noted", "address", "last", "other")

    def __init__(self):
        self.key, self.marks, self.n, self.filled = 0, set(), 0, 0
        self.place, self.domain, self.name, self.phone, self.email = set(), set(), set(), set(), set()
        self.classes: dict[int, list[_Class]] = {}
        self.at: dict[str, set[_Class]] = {}  # by address, '' for none
        self.several: set[_Class] = set()  # classes of two addresses or more that still can lie apart
        self.noted: dict[int, int] = {}
        self.address, self.last, self.other = "", 0, 0


class LeadGroups:
    """Rows of one block, added in order; ``placed`` then gives each row's group. Some 50 bytes a row are held, and the classes."""

    def __init__(self):
        self.shapes: dict[int, list[_Shape]] = {}
        self.under: dict[tuple, dict[_Shape, None]] = {}
        self.rows, self.owners = array("q"), array("q")
        self.first, self.since, self.mask = array("q"), array("q"), array("b")
        self.home: list[_Class] = []

    def add(self, number: int, place: str, domain: str, name: str, phone: str, email: str, address: str) -> None:
        self.rows.append(number)
        now, under = len(self.rows), self.under
        keys = []
        if place:
            keys.append((MAPS, place))
        if domain:
            keys.append((DOMAIN, domain))
        if name and phone:
            keys.append((NAME_PHONE, name, phone))
        if name and email:
            keys.append((NAME_EMAIL, name, email))
        best: dict[_Shape, int] = {}
        for key in keys:
            for s in under.get(key, ()):
                best.setdefault(s, key[0])
        by_name = not best
        if by_name and name:
            best = dict.fromkeys(under.get((NAME, name), ()), NAME)
        shared, area, met, vetoed = 0, False, 0, False
        rank, tied, own = 9, 0, -1
        against = []
        for s, kind in best.items():
            veto = 0
            if kind == DOMAIN:
                if place and s.place and place not in s.place:
                    veto = PLACES  # of a place there is one group
                    if phone and s.phone and phone not in s.phone or address and s.filled and address not in s.at:
                        veto |= BRANCHES
                elif name and phone and s.name and s.phone and name not in s.name and phone not in s.phone:
                    veto = SITES
            elif kind != MAPS:
                if place and s.place and place not in s.place:
                    veto = PLACES
                if domain and s.domain and domain not in s.domain:
                    veto |= SITES
                if by_name:
                    if phone and s.phone and phone not in s.phone or email and s.email and email not in s.email:
                        veto |= SITES
                    if address and s.filled > len(s.at.get(address, ())):
                        area = vetoed = True
            met += s.n
            against.append(veto)
            if veto:
                shared |= veto
                vetoed = True
            elif kind <= rank:
                if kind < rank:
                    rank, tied = kind, 0
                if tied < 2:
                    if by_name and address:
                        for c in (*s.at.get(address, ()), *s.at.get("", ())):
                            tied, own = tied + c.n, c.only
                    else:
                        tied, own = tied + s.n, (next(iter(s.classes.values()))[0].only if s.n == 1 else -1)
        every = 0  # for all that were met
        if not by_name and met > 1:
            every = BRIDGE
        if by_name and met and (vetoed or tied > 1):
            every = UNCLEAR
        at_tied = UNCLEAR if tied > 1 and not by_name else 0
        for (s, kind), veto in zip(best.items(), against, strict=True):
            given = veto | every | (at_tied if not veto and kind == rank else 0)
            if given:
                s.noted[given] = now
            if by_name and address:
                self._apart(s, address, now)
        shared |= every | at_tied | (AREA if area else 0)
        if name:
            keys.append((NAME, name))
        if phone:
            keys.append((PHONE, phone))
        if email:
            keys.append((EMAIL, email))
        if tied == 1:
            self.mask[own] |= shared
            self._learn(own, keys, address, now)
        else:
            own = len(self.first)
            self.first.append(number)
            self.mask.append(shared)
            self.since.append(now)
            self.home.append(None)
            self._settle(own, self._shape(set(keys)), hash(address) if address else 0, {address} if address else set())
        self.owners.append(own)

    @staticmethod
    def _apart(s: _Shape, address: str, now: int) -> None:
        if address != s.address:
            s.address, s.other = address, s.last
        s.last = now
        if s.several:
            for c in [c for c in s.several if address not in c.addresses]:
                c.area = now
                s.several.discard(c)

    def _reasons(self, g: int) -> int:
        """The group's own reasons and those noted since it came into its class."""
        c, since, mask = self.home[g], self.since[g], self.mask[g]
        s = c.shape
        for reasons, number in s.noted.items():
            if number > since:
                mask |= reasons
        if len(c.addresses) > 1:
            last = c.area
        else:
            last = 0 if not c.addresses else s.other if s.address in c.addresses else s.last
        return mask | AREA if last > since else mask

    def _learn(self, g: int, keys: list[tuple], address: str, now: int) -> None:
        """Evidence of a row for its group, which is alone in its class."""
        c = self.home[g]
        s = c.shape
        fresh = {k for k in keys if k not in s.marks}
        more = address and address not in c.addresses
        if not fresh and not more:
            return
        self.mask[g] = self._reasons(g)
        self.since[g] = now
        self._leave(c)
        if fresh:
            if s.n:
                s = self._shape(s.marks | fresh)
            else:
                s = self._grown(s, fresh)
        addresses, key = c.addresses, c.key
        if more:
            addresses.add(address)
            key ^= hash(address)
        self._settle(g, s, key, addresses)

    def _leave(self, c: _Class) -> None:
        s = c.shape
        bucket = s.classes[c.key]
        bucket.remove(c)
        if not bucket:
            del s.classes[c.key]
        for a in c.addresses or ("",):
            s.at[a].discard(c)
            if not s.at[a]:
                del s.at[a]
        s.filled -= bool(c.addresses)
        s.several.discard(c)
        s.n -= 1

    def _settle(self, g: int, s: _Shape, key: int, addresses: set[str]) -> None:
        bucket = s.classes.setdefault(key, [])
        c = next((c for c in bucket if c.addresses == addresses), None)
        if c is None:
            c = _Class(key, addresses)
            c.shape = s
            bucket.append(c)
            for a in addresses or ("",):
                s.at.setdefault(a, set()).add(c)
            s.filled += bool(addresses)
        c.n += 1
        c.only = g
        s.n += 1
        if len(addresses) > 1:
            s.several.add(c)
        self.home[g] = c

    def _shape(self, marks: set[tuple]) -> _Shape:
        key = 0
        for mark in marks:
            key ^= hash(mark)
        found = next((s for s in self.shapes.get(key, ()) if s.marks == marks), None)
        if found is None:
            found = _Shape()
            self._mark(found, key, marks)
        return found

    def _grown(self, s: _Shape, fresh: set[tuple]) -> _Shape:
        """The shape of an empty shape's marks and more: another that has these, or itself with what it lacks."""
        key = s.key
        for mark in fresh:
            key ^= hash(mark)
        bucket = self.shapes[s.key]
        bucket.remove(s)
        if not bucket:
            del self.shapes[s.key]
        size = len(s.marks) + len(fresh)
        for other in self.shapes.get(key, ()):
            if len(other.marks) == size and fresh <= other.marks and s.marks <= other.marks:
                for mark in s.marks:
                    if mark[0] <= NAME:
                        del self.under[mark][s]
                return other
        self._mark(s, key, fresh)
        return s

    def _mark(self, s: _Shape, key: int, marks: set[tuple]) -> None:
        s.key = key
        self.shapes.setdefault(key, []).append(s)
        s.marks |= marks
        sets = {MAPS: s.place, DOMAIN: s.domain, NAME: s.name, PHONE: s.phone, EMAIL: s.email}
        for mark in marks:
            if mark[0] in sets:
                sets[mark[0]].add(mark[1])
            if mark[0] <= NAME:
                self.under.setdefault(mark, {})[s] = None

    def placed(self) -> Iterator[tuple[int, int, str]]:
        """Row, first row of its group, and the group's reasons."""
        done = array("b", bytes(len(self.first)))
        for number, g in zip(self.rows, self.owners, strict=True):
            if not done[g]:
                self.mask[g], done[g] = self._reasons(g), 1
            yield number, self.first[g], TEXTS[self.mask[g]]
