"""Experiments: single domain, train on one and test on another, leave one domain out."""
