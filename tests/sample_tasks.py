"""Tasks for the command line's tests."""

from sluice.plans import task

first = task(lambda: 1, name="first")
leaf = task(lambda x: x + 1, first, name="leaf")


def make(text):
    return task(lambda: text * 2, name="made")


class Flow:
    end = leaf
