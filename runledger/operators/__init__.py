"""Operators over canonical events, prediction rows and scored forecasts."""
