"""Operators over bars, panels, forecasts and journals."""
