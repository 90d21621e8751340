"""Imports every module that registers queries of the reference operators."""

from . import averages, canvasses, checking, composites, contests, details, facts, files, identities, models, names, offices, outlook, records, seals, shapes, timing  # noqa: F401
