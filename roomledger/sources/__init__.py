"""Readers, writers and the adapter that derives bookings from other tables."""
