"""rollcall.functions"""
