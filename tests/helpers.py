"""Small fixtures for all tests."""

import datetime as dt


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ts(text):
    return dt.datetime.fromisoformat(text)
