"""The filter language: what a lookup asks for, and the parser of its text form."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from decimal import Decimal

# Words for action lists, after one leading # is stripped.
ACTION_WORDS: dict[tuple[int, ...], str] = {
    (0,): "broke break remove destroy block-break block-remove -block -blocks block-",
    (1,): "placed place block-place +block +blocks block+",
    (0, 1): "block blocks block-change change changes",
    (2,): "click clicks interact interaction player-interact player-interaction player-click",
    (3,): "death deaths entity-death entity-deaths kill kills entity-kill entity-kills",
    (4,): "container container-change containers chest transaction transactions",
    (4, 0): "-container container- remove-container",
    (4, 1): "+container container+ container-add add-container",
    (6,): "chat chats",
    (7,): "command commands",
    (8, 1): "logins login +session +sessions session+ +connection connection+",
    (8, 0): "logout logouts -session -sessions session- -connection connection-",
    (8,): "session sessions connection connections",
    (9,): "username usernames user users name names uuid uuids username-change username-changes name-change name-changes",
    (10,): "sign signs",
    (4, 11): "inv inventory inventories",
    (4, 11, 1): "-inv inv- -inventory inventory- -inventories",
    (4, 11, 0): "+inv inv+ +inventory inventory+ +inventories",
    (11,): "item items",
    (11, 0): "-item item- -items items- drop drops deposit deposits deposited",
    (11, 1): "+item item+ +items items+ pickup pickups withdraw withdraws withdrew",
}
_ACTIONS = {w: list(codes) for codes, words in ACTION_WORDS.items() for w in words.split()}
UNIT_SECONDS = {"y": 31_536_000, "mo": 2_592_000, "w": 604_800, "d": 86_400, "h": 3_600, "m": 60, "s": 1}
_UNIT_NAMES = {"y": "year", "mo": "month", "w": "week", "d": "day", "h": "hour", "m": "minute", "s": "second"}
FLAGS = {"count": "count", "sum": "count", "verbose": "verbose", "silent": "silent", "preview": "preview", "preview_cancel": "preview_cancel", "optimize": "optimize"}
#: Fixed value: members of the type tags, as endings or words of material names.
TAGS = {
    "#button": ("_button",), "#container": ("chest", "crate", "barrel", "hopper", "hopperette", "furnace", "dispenser", "dropper", "shulker_box"), "#door": ("_door", "_trapdoor", "_gate"),
    "#natural": ("_clay", "_basal", "_thatch", "_stone", "_dirt", "_grass", "_leaves"), "#pressure_plate": ("_pressure_plate",), "#shulker_box": ("shulker_box",), "#bundle": ("bundle",),
}
MAX_RADIUS, DEFAULT_RADIUS, USER_PAGE_CAP, CONSOLE_PAGE_CAP = 100, 10, 100, 1000
_KEYS = {"t": "t", "time": "t", "u": "u", "user": "u", "users": "u", "uuid": "u", "r": "r", "radius": "r", "a": "a", "action": "a", "i": "i", "include": "i", "e": "e", "exclude": "e", "c": "c", "coord": "c", "coords": "c", "rows": "rows", "page": "page", "p": "page"}


class SpecError(ValueError):
    """A filter that can't be planned."""


@dataclass(frozen=True)
class Box:
    """Inclusive bounds; y is open where None."""

    x: tuple[int, int]
    z: tuple[int, int]
    y: tuple[int, int] | None = None

    @classmethod
    def around(cls, x: int, y: int, z: int, r: tuple[int, int | None, int]) -> Box:
        rx, ry, rz = r
        return cls((x - rx, x + rx), (z - rz, z + rz), None if ry is None else (y - ry, y + ry))


@dataclass(frozen=True)
class LookupSpec:
    """A lookup. Times are absolute epoch seconds, (start, end], 0 for open; names are resolved to ids when planned."""

    actions: tuple[int, ...] = ()
    users: tuple[str, ...] = ()
    exclude_users: tuple[str, ...] = ()
    start: int = 0
    end: int = 0
    wid: int | None = None
    world: str | None = None
    box: Box | None = None
    double_container: tuple[float, float, float] | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    page: int = 1
    rows: int = 7
    flags: frozenset[str] = field(default_factory=frozenset)
    auto_excluded: tuple[str, ...] = ()  # those of the excludes which were added by settings, not asked for
    unknown_users: bool = False  # whether a name without a user is a user without entries; else it is an error, as commands have it

    @property
    def inventory(self) -> bool:
        return 4 in self.actions and 11 in self.actions

    @property
    def union(self) -> bool:
        return not self.actions or self.inventory


def parse_time(text: str) -> tuple[int, int]:
    """Seconds back from now of the older and the newer bound; the newer is 0 without a range.

    Units y mo w d h m s with decimals, joined or separated by commas; of a repeated unit the first counts.
    """
    parts = text.lower().replace(",", "").split("-")
    if len(parts) > 2:
        raise SpecError(f"not a time: {text}")
    both = [_seconds(p) for p in parts if p]
    if not both or max(both) <= 0:
        raise SpecError(f"not a time: {text}")
    return (max(both), min(both) if len(both) == 2 else 0)


def _amounts(text: str) -> dict[str, Decimal]:
    found: dict[str, Decimal] = {}
    at = 0
    for m in re.finditer(r"(\d+(?:\.\d+)?|\.\d+)(mo|[ywdhms])", text):
        if m.start() != at:
            raise SpecError(f"not a time: {text}")
        found.setdefault(m[2], Decimal(m[1]))
        at = m.end()
    if at != len(text):
        raise SpecError(f"not a time: {text}")
    return found


def _seconds(text: str) -> int:
    return int(sum((n * UNIT_SECONDS[u] for u, n in _amounts(text).items()), Decimal(0)))


def time_text(text: str) -> str:
    """How a time is shown: amounts without trailing zeros with their unit names, ranges with a dash."""
    shown = []
    for part in text.lower().replace(",", "").split("-"):
        words = []
        for u, n in _amounts(part).items():
            amount = format(n.normalize(), "f")
            words.append(f"{amount} {_UNIT_NAMES[u]}{'' if amount == '1' else 's'}")
        shown.append(", ".join(words))
    return " - ".join(shown)


def parse_actions(word: str) -> list[int]:
    """Codes of an action word; [-1] for an unknown one."""
    w = word.lower().strip()
    return list(_ACTIONS.get(w[1:] if w.startswith("#") else w, [-1]))


def parse_radius(text: str) -> tuple[int, int | None, int] | None:
    """x, y and z reach; a single number leaves y open; None for #global and #world words."""
    if text.startswith("#") or text == "global":
        return None
    m = re.fullmatch(r"(\d+)(?:x(\d+)x(\d+))?", text)
    if not m:
        raise SpecError(f"not a radius: {text}")
    return (int(m[1]), None, int(m[1])) if m[2] is None else (int(m[1]), int(m[2]), int(m[3]))


def parse_coords(text: str, floor: int = -64, ceiling: int = 320) -> tuple[int, int | None, int]:
    """x,z or x,y,z; y is held within the world."""
    try:
        n = [int(float(p)) for p in text.split(",")]
    except ValueError as e:
        raise SpecError(f"not coordinates: {text}") from e
    if len(n) == 2:
        return n[0], None, n[1]
    if len(n) == 3:
        return n[0], max(floor, min(ceiling, n[1])), n[2]
    raise SpecError(f"not coordinates: {text}")


def match_world(word: str, worlds: list[tuple[int, str]]) -> int | None:
    """World id for #name: an exact name, else the last one that ends in it, also without signs; wid:N is taken as is."""
    w = word.lower().lstrip("#")
    if re.fullmatch(r"wid:\d+", w):
        return int(w[4:])
    bare = re.sub(r"[^a-z0-9]", "", w)
    best = None
    for i, name in sorted(worlds):
        n = name.lower()
        if n == w:
            return i
        if n.endswith(w) or (bare and re.sub(r"[^a-z0-9]", "", n).endswith(bare)):
            best = i
    return best


def tokens(text: str) -> list[tuple[str, str]]:
    """(key, value) pairs; 'k:v' and 'k: v' alike, bare words are users, # words are flags."""
    out: list[tuple[str, str]] = []
    pending = None
    for raw in text.lower().replace("\\", "").replace("'", "").split():
        key, sep, value = raw.partition(":")
        if pending is not None and not (sep and key in _KEYS):
            out.append((pending, raw))
            pending = None
        elif sep and key in _KEYS:
            if value:
                out.append((_KEYS[key], value))
                pending = None
            else:
                pending = _KEYS[key]
        elif raw.startswith("#") and raw[1:] in FLAGS:
            out.append(("flag", FLAGS[raw[1:]]))
        elif raw == "page":
            pending = "page"
        else:
            out.append(("u", raw))
    return out


def parse(text: str, now: int, at: tuple[int, int, int, int] | None = None, worlds: list[tuple[int, str]] = (), types: frozenset[str] = frozenset(), console: bool = False, rollback: bool = False) -> LookupSpec:
    """Parses and validates a filter. ``now`` is the clock; ``at`` is the asker's (wid, x, y, z), needed by a radius;
    ``types`` are the known type names (an e: word that isn't one excludes a user)."""
    spec = LookupSpec()
    radius: tuple[int, int | None, int] | None = None
    center = at
    users: list[str] = []
    ex_users: list[str] = []
    inc: list[str] = []
    exc: list[str] = []
    flags: set[str] = set()
    world_given = timed = False
    for key, value in tokens(text):
        if key == "t":
            older, newer = parse_time(value)
            spec = replace(spec, start=now - older, end=now - newer if newer else 0)
            timed = True
        elif key == "a":
            codes = parse_actions(value)
            if codes == [-1]:
                raise SpecError(f"unknown action: {value}")
            spec = replace(spec, actions=tuple(codes))
        elif key == "u":
            users += [u for u in value.split(",") if u and u != "#global"]
        elif key == "i":
            inc += [_name(w) for w in value.split(",") if w]
        elif key == "e":
            for w in filter(None, value.split(",")):
                (exc if w in TAGS or _name(w) in types else ex_users).append(_name(w) if w in TAGS or _name(w) in types else w)
        elif key == "r":
            radius = parse_radius(value)
            if radius is None and value.lstrip("#") != "global":
                wid = match_world(value, list(worlds))
                if wid is None:
                    raise SpecError(f"unknown world: {value}")
                spec, world_given = replace(spec, wid=wid), True
        elif key == "c":
            x, y, z = parse_coords(value)
            center = (at[0] if at else None, x, at[2] if y is None and at else y, z)
        elif key == "rows":
            spec = replace(spec, rows=int(value))
        elif key == "page":
            page, _, rows = value.partition(":")
            spec = replace(spec, page=int(page), rows=int(rows) if rows else spec.rows)
        else:
            flags.add(value)
    unknown = [w for w in inc if w not in TAGS and types and w not in types]
    if unknown:
        raise SpecError(f"unknown type: {unknown[0]}")
    if rollback and radius is None and not world_given and at:
        radius = (DEFAULT_RADIUS, None, DEFAULT_RADIUS)
    if radius is not None:
        if center is None:
            raise SpecError("a radius needs a place")
        if max(r for r in radius if r is not None) > MAX_RADIUS and not console:
            raise SpecError(f"the radius is over {MAX_RADIUS}")
        spec = replace(spec, wid=center[0] if spec.wid is None else spec.wid, box=Box.around(center[1], center[2] or 0, center[3], radius))
    cap = CONSOLE_PAGE_CAP if console else USER_PAGE_CAP
    spec = replace(spec, users=tuple(users), exclude_users=tuple(ex_users), include=tuple(inc), exclude=tuple(exc), flags=frozenset(flags), rows=max(1, min(spec.rows, cap)), page=max(1, spec.page))
    return validate(spec, timed, rollback)


def _name(word: str) -> str:
    return word if word.startswith("#") or ":" in word else f"ns:{word}"


def validate(spec: LookupSpec, timed: bool = True, rollback: bool = False) -> LookupSpec:
    """The rules which a filter must keep; an included entity implies kills."""
    entity = [w for w in spec.include if w.startswith("entity:")]
    if entity and len(entity) < len(spec.include):
        raise SpecError("blocks and entities can't be mixed")
    if entity and not spec.actions:
        spec = replace(spec, actions=(3,))
    if (spec.include or spec.exclude) and any(a in spec.actions for a in (6, 7, 8, 9, 10)):
        raise SpecError("types don't go with messages, sessions, names or signs")
    if spec.box and 9 in spec.actions:
        raise SpecError("a radius doesn't go with names")
    if spec.inventory and not spec.users:
        raise SpecError("an inventory lookup needs a user")
    if not timed and (rollback or spec.users or spec.include):
        raise SpecError("a time is needed")
    return spec


@dataclass(frozen=True)
class PurgeSpec:
    """Rows to purge: start <= time < end, optionally of one world or of block types."""

    start: int
    end: int
    wid: int | None = None
    types: tuple[int, ...] = ()


def parse_purge(text: str, now: int, worlds: list[tuple[int, str]] = (), type_ids: dict[str, int] | None = None, console: bool = False) -> PurgeSpec:
    """t:, r:#world and i: of a purge; at least 30 days back in game, 24 hours on the console."""
    window, wid, types = None, None, ()
    for key, value in tokens(text):
        if key == "t":
            window = parse_time(value)
        elif key == "r" and value.startswith("#"):
            wid = match_world(value, list(worlds))
            if wid is None:
                raise SpecError(f"unknown world: {value}")
        elif key == "i":
            types = tuple((type_ids or {}).get(_name(w), 0) for w in value.split(","))
        elif key != "flag":
            raise SpecError("a purge takes a time, a world or types only")
    if window is None:
        raise SpecError("a time is needed")
    older, newer = window
    least = newer or older
    if least < (86_400 if console else 30 * 86_400):
        raise SpecError("that is too recent to purge")
    return PurgeSpec(now - older if newer else 0, now - least, wid, types)
