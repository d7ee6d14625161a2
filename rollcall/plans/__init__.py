"""rollcall.plans"""
