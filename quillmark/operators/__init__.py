"""Relational operators over filings, holdings, insider trades and news."""
