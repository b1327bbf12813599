"""Registered queries: operators over adapters of the test tables, each with the SQL that must agree."""
