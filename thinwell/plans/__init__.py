"""Configuration and ready-made queries."""
