"""Operators of a training-data pipeline. Nothing else in tierscope imports this subpackage."""
