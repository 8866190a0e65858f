"""Values as short words for notices and pages."""

from __future__ import annotations

from urllib.parse import urlsplit


def humanize(ms: int) -> str:
    """A span in its largest whole unit: 42s, 3m, 5h, 2d."""
    seconds = ms // 1000
    size, unit = next((n, u) for n, u in ((86_400, "d"), (3_600, "h"), (60, "m"), (1, "s")) if seconds >= n or n == 1)
    return f"{seconds // size}{unit}"


def number(value: float) -> str:
    """Whole numbers without a point, others with two digits."""
    return str(int(value)) if value == value // 1 and abs(value) < 1e15 else f"{value:.2f}"


def host(url: str) -> str:
    """The host of an address, with its port; what stands before the first slash if there is no scheme."""
    return urlsplit(url if "://" in url else f"//{url}").netloc
