"""Derived datasets: joins, aggregations, rankings and change history."""
