"""Schemas of contacts, change proposals, messages and logs."""

from __future__ import annotations

_date = "STRUCT<year: INT, month: INT, day: INT>"
CONTACT = f"""resourceName STRING,
names ARRAY<STRUCT<displayName: STRING, givenName: STRING, familyName: STRING, middleName: STRING, unstructuredName: STRING, honorificPrefix: STRING, honorificSuffix: STRING>>,
emailAddresses ARRAY<STRUCT<value: STRING, type: STRING>>,
phoneNumbers ARRAY<STRUCT<value: STRING, type: STRING>>,
addresses ARRAY<STRUCT<streetAddress: STRING, city: STRING, postalCode: STRING, country: STRING, countryCode: STRING, formattedValue: STRING, type: STRING>>,
organizations ARRAY<STRUCT<name: STRING, title: STRING>>,
biographies ARRAY<STRUCT<value: STRING, contentType: STRING>>,
urls ARRAY<STRUCT<value: STRING, type: STRING>>,
birthdays ARRAY<STRUCT<date: {_date}>>,
events ARRAY<STRUCT<date: {_date}, type: STRING>>,
userDefined ARRAY<STRUCT<key: STRING, value: STRING>>,
nicknames ARRAY<STRUCT<value: STRING, type: STRING>>"""
CHANGE = "STRUCT<field: STRING, old: STRING, new: STRING, confidence: DOUBLE, reason: STRING, extra: MAP<STRING, STRING>>"
INTERACTION = """interactionId STRING, contactId STRING, matchCandidates STRUCT<emails: ARRAY<STRING>, phones: ARRAY<STRING>, handles: ARRAY<STRING>>,
channel STRING, direction STRING, threadId STRING, timestamp TIMESTAMP, subject STRING, summary STRING, fullTextRef STRING,
participants ARRAY<STRUCT<kind: STRING, value: STRING, name: STRING, self: BOOLEAN>>, metadata STRING"""
LOG = "type STRING, timestamp TIMESTAMP, resourceName STRING, field STRING, old STRING, new STRING, reason STRING, confidence DOUBLE, batch INT, contact_count INT, success INT, failed INT, session_id STRING"
DUPLICATE, INVALID, DELETE = "__DUPLICATE__", "__INVALID__", "__TO_BE_DELETED__"
