"""Absorption correction of X-ray diffraction data as DataFrame jobs."""
