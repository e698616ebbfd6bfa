"""Opportunity-intelligence jobs as plain DataFrame functions on Spark."""
