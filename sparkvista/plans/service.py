"""Checks of arguments, and envelopes: the only place where results are collected."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from ..operators import discovery
from ..operators.timeline import METRICS, PERIODS, Scope, compare, timeline


class ServiceError(ValueError):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def _need(ok: bool, message: str, status: int = 400) -> None:
    if not ok:
        raise ServiceError(status, message)


def _rows(df: DataFrame) -> list[dict]:
    return [{k: v.isoformat() if isinstance(v, date) else v for k, v in r.asDict().items()} for r in df.collect()]


class ReviewService:
    """The API over a businesses and a reviews table."""

    def __init__(self, businesses: DataFrame, reviews: DataFrame):
        self.businesses, self.reviews = businesses, reviews

    def business(self, business_id: object) -> dict:
        found = _rows(discovery.by_id(self.businesses, "business_id", business_id))
        _need(bool(found), f"business {business_id} not found", 404)
        return found[0]

    def list(self, state: str | None = None, city: str | None = None, skip: int = 0, limit: int = 100) -> list[dict]:
        """The state is taken in upper case."""
        _need(skip >= 0 and 1 <= limit <= 1_000, "skip or limit out of range", 422)
        return _rows(discovery.list_businesses(self.businesses, state and state.upper(), city, skip, limit))

    def viewport(self, south: float, west: float, north: float, east: float, limit: int = 1_000) -> list[dict]:
        _need(all(abs(x) <= 90 for x in (south, north)) and all(abs(x) <= 180 for x in (west, east)) and 1 <= limit <= 5_000, "coordinate or limit out of range", 422)
        _need(south < north and west < east, "south must be below north, and west below east")
        return _rows(discovery.in_viewport(self.businesses, south, west, north, east, limit))

    def search(self, query: str, skip: int = 0, limit: int = 20) -> list[dict]:
        _need(len(query) >= 1 and skip >= 0 and 1 <= limit <= 100, "query, skip or limit out of range", 422)
        return _rows(discovery.search(self.businesses, query, skip, limit).drop("relevance"))

    def states(self) -> list[str]:
        return [r["state"] for r in discovery.states(self.businesses).collect()]

    def cities(self, state: str) -> list[str]:
        _need(len(state) == 2, "a state has two letters", 422)
        return [r["city"] for r in discovery.cities_of(self.businesses, state.upper()).collect()]

    def _check(self, period: str, metric: str = "rating") -> None:
        _need(period in PERIODS, f"period must be one of {', '.join(PERIODS)}")
        _need(metric in METRICS, f"metric must be one of {', '.join(METRICS)}")

    def business_timeline(self, business_id: object, metric: str = "rating", period: str = "month", start: str | None = None, end: str | None = None) -> dict:
        self._check(period, metric)
        name = self.business(business_id)["name"]
        data = _rows(timeline(self.reviews, Scope("business", business_id), metric, period, start, end))
        return {"business_id": business_id, "business_name": name, "metric": metric, "period": period, "start_date": start, "end_date": end, "data": data}

    def area_timeline(self, state: str, city: str | None = None, metric: str = "rating", period: str = "month", start: str | None = None, end: str | None = None) -> dict:
        """The state is taken as it is written; an unknown one has no data."""
        self._check(period, metric)
        _need(len(state) == 2, "a state has two letters", 422)
        data = _rows(timeline(self.reviews, Scope("city" if city else "state", city=city, state=state), metric, period, start, end, self.businesses))
        return {"state": state, **({"city": city} if city else {}), "metric": metric, "period": period, "start_date": start, "end_date": end, "data": data}

    def comparison(self, business_id: object, kind: str, metric: str = "rating", period: str = "month", start: str | None = None, end: str | None = None) -> dict:
        self._check(period, metric)
        _need(kind in ("city", "state"), "a business is compared with its city or state", 422)
        own = self.business(business_id)
        rows = _rows(compare(self.reviews, self.businesses, business_id, kind, metric, period, start, end))
        side = lambda tag: [{k: v for k, v in r.items() if k != "data_type"} for r in rows if r["data_type"] == tag]
        return {"business_id": business_id, "business_name": own["name"], kind: own[kind], "metric": metric, "period": period, "start_date": start, "end_date": end, "business_data": side("business"), f"{kind}_average": side(kind)}

    def root(self) -> dict:
        return {"message": "Business analytics", "status": "healthy"}

    def health(self) -> dict:
        return {"status": "healthy"}
