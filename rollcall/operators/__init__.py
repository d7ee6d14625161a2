"""rollcall.operators"""
