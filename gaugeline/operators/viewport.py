"""Arithmetic of a viewer's time window: plain numbers, worked out before a query is planned."""

from __future__ import annotations

from dataclasses import dataclass

LEAST_SHARE = 1e-7
LEAST_SPAN = 1e-9


@dataclass(frozen=True)
class Viewport:
    """A window inside a full extent."""

    start: float
    end: float
    full_start: float
    full_end: float

    @property
    def span(self) -> float:
        return self.end - self.start

    def _within(self, start: float, end: float) -> Viewport:
        """The window slid back into the extent; no wider than it, no narrower than the least span."""
        whole = self.full_end - self.full_start
        least = min(whole, max(LEAST_SHARE * whole, LEAST_SPAN))
        span = min(whole, max(least, end - start))
        start = min(max(start, self.full_start), self.full_end - span)
        return Viewport(start, start + span, self.full_start, self.full_end)

    def zoom(self, factor: float, anchor: float) -> Viewport:
        """Narrower for factors above 1; the anchor keeps its place in the window."""
        share = (anchor - self.start) / self.span if self.span else 0.5
        span = self.span / factor
        return self._within(anchor - share * span, anchor + (1 - share) * span)

    def pan(self, by: float) -> Viewport:
        return self._within(self.start + by, self.end + by)

    def between(self, a: float, b: float) -> Viewport:
        return self._within(min(a, b), max(a, b))
